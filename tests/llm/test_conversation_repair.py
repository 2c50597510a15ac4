import hashlib
import random
import zlib
from collections import defaultdict
from functools import cache

import pytest

from orderlens.llm import conversation_repair as repair

SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if part == 1:
            text = ""
        if part == 2:
            text = "".join(c for c in text if c not in ".!?")
        if part == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(part, 1)
    return out


def plain(rows):
    """Faults, and the cheapest edits by trying all of them at every row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.strip(SPACE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    turns = {t for t, _, _ in rows if t is not None}
    counts = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]

    def after(last, letter):
        """The last letter after one more, or None where the roles don't allow it."""
        return letter if (last, letter) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")} else None

    @cache
    def best(i, last, inserts):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserts < 2:
            for role in ("user", "assistant"):
                if after(last, role[0]):
                    cost, edits, lines = best(i, role[0], inserts + 1)
                    options.append((cost + 3, "I" + edits, ((role, ""), *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, edits, lines = best(i + 1, last, 0)
            options.append((cost + 4, "D" + edits, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for letter, to, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if after(last, to[:1]):
                        cost, edits, lines = best(i + 1, to[:1], 0)
                        options.append((cost + price + extra, letter + edits, ((to, text), *lines)))
        return min(options, default=(10**9, "", ()))

    cost, edits, lines = best(0, "", 0)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **counts,
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": edits,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    }, lines


def made_up(seed, conversations, longest):
    pick = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for _ in range(pick.randint(0, longest)):
            turn = pick.choice([None, *range(-1, longest)])
            role = pick.choice(["system", "user", "user", "assistant", "assistant", None, "tool", "", "User"])
            text = pick.choice(["a.", "b", "c!", "d? ", "", None, " \n", "é.", "x" * 70 + "1.", "x" * 70 + "2."])
            rows.append((conv or None, turn, role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "conversations", "longest"), [(1, 150, 6), (2, 40, 25)])
def test_equals_brute_force(spark, seed, conversations, longest):
    rows = made_up(seed, conversations, longest)
    df = repair.damage(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {r.conv_id: r.asDict() for r in repair.audit(df).collect()}
    want = {c: plain(r) for c, r in damaged(rows).items()}
    assert len(got) == len(want)
    for conv, (row, lines) in want.items():
        assert {"conv_id": conv, **row} == got[conv]
    written = defaultdict(list)
    for r in sorted(repair.repair(df).collect(), key=lambda r: r.position):
        assert r.position == len(written[r.conv_id])
        written[r.conv_id].append((r.role, r.text))
    assert {c: tuple(x) for c, x in written.items()} == {c: lines for c, (_, lines) in want.items() if lines}


def test_block_lookup_equals_single_steps():
    t = repair.tables()
    pick = random.Random(4)
    assert len(t.step) == len(t.vectors) < 100 and len(t.step[0]) == repair.KINDS**repair.BLOCK
    for _ in range(3000):
        kinds = [pick.randrange(repair.NO_ROW) for _ in range(pick.randint(1, repair.BLOCK))]
        v = pick.randrange(len(t.vectors))
        rest = t.vectors[v]
        for kind in reversed(kinds):
            rest = repair.before(rest, kind)
        assert t.vectors[t.step[v][t.code(kinds)]] == tuple(c - min(rest) for c in rest)


def test_long_conversation_and_many_copies(spark):
    rows = [(1, i, ("user", "assistant", "user", "system")[i * i % 7 % 4], f"text {i}" + "." * (i % 3 > 0)) for i in range(300)]
    rows += [(1, 150, "user", "the same.")] * 400 + [(2, None, "user", "again.")] * 500
    rows += [(3, i, "assistant", "same all over!") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: r.asDict() for r in repair.audit(df).collect()}
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(tuple(row))
    import sys

    sys.setrecursionlimit(20_000)
    for conv, members in by.items():
        assert got[conv] == {"conv_id": conv, **plain(members)[0]}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audit(repair.damage(empty)).count() == 0 and repair.repair(empty).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    clash = spark.createDataFrame([(gone, 1, "user", "hi.", "x", 5)], SCHEMA + ", digest string, kind int")
    (row,) = repair.audit(repair.damage(clash)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    words = spark.createDataFrame([("x", 1, "user", "long " * 300_000 + "."), ("x", 2, "assistant", "ok."), (None, 1, "a", "b.")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: (r.audit, r.cost) for r in repair.audit(words).collect()}
    assert got == {"x": ("KK", 0), None: ("IK", 3)}
