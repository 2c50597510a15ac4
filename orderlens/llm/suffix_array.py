"""Suffix array by linear grouping.

Suffixes start in groups of their first symbol. The groups are processed in descending order:
each suffix of a group points to the previous suffix of a smaller group, and the suffixes
pointed at move up, behind the rest of their own group, sorted by how many point at them; so
in the end every group holds the suffixes of one Lyndon prefix. Then the order inside the
groups is read off from the smallest suffix on: a suffix that has its place gives the next
free place of its group to the suffix before it and to all that its pointers lead to. No
symbol is renamed and nothing recurses; both passes are linear in the length.
"""

from __future__ import annotations

from collections import defaultdict


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in ascending order; an end counts as the smallest symbol."""
    n = len(symbols) + 1
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(symbols):
        by_symbol[s].append(i)
    members = [[n - 1], *(by_symbol[s] for s in sorted(by_symbol))]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    size = [len(own) for own in members]
    lower = list(range(-1, len(members) - 1))
    higher = [*range(1, len(members)), -1]
    done = [False] * len(members)
    previous = [-1] * n

    current = len(members) - 1
    while current >= 0:
        done[current] = True
        pointed: dict[int, int] = {}
        for i in members[current]:
            if group[i] != current:
                continue  # has moved to a group of its own since
            j = i - 1
            while j >= 0 and done[group[j]]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = defaultdict(list)
        for j, times in pointed.items():
            by_count[times].append(j)
        for times in sorted(by_count, reverse=True):
            moving: dict[int, list[int]] = defaultdict(list)
            for j in by_count[times]:
                moving[group[j]].append(j)
            for g, some in moving.items():
                if len(some) == size[g]:
                    continue
                new = len(members)
                some.sort()
                members.append(some)
                size.append(len(some))
                size[g] -= len(some)
                done.append(False)
                lower.append(g)
                higher.append(higher[g])
                lower[higher[g]] = new
                higher[g] = new
                for j in some:
                    group[j] = new
        current = lower[current]

    free = [0] * len(members)
    g, at = 0, 0
    while g >= 0:
        free[g] = at
        at += size[g]
        g = higher[g]
    order, placed = [-1] * n, [False] * n
    order[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            order[free[group[j]]] = j
            free[group[j]] += 1
            placed[j] = True
            j = previous[j]
    return order[1:]
