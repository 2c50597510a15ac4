import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from orderlens.llm import lexical_search
from orderlens.llm.queries import ORACLE, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item, text in set(items):
        scores = []
        for doc, c in counted:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        rows += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(rows, key=str)


def made_up(seed, n):
    pick = random.Random(seed)
    vocabulary = [f"w{int(pick.paretovariate(0.7))}" for _ in range(400)] + ["Straße", "ÀB", "日本", "x1", "X1"]
    texts = [" ".join(pick.choice(vocabulary) for _ in range(pick.choice([0, 1, 3, 20, 60]))) for _ in range(n)]
    texts += [texts[1]] * (n // 3) + [None, "", "...", "w1 " * 30_000]
    docs = [(pick.choice([None, *range(n)]) if i % 7 == 0 else i, t) for i, t in enumerate(texts)]
    items = [(i % 25, " ".join(pick.choice(vocabulary) for _ in range(pick.choice([1, 5, 30])))) for i in range(30)]
    return docs, items + [items[0], (77, None), (78, ""), (79, "notthere"), (None, "w1-x1, STRASSE straße")]


def found(spark, docs, items, **more):
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in lexical_search.search(left, spark.createDataFrame(items, "item_id long, text string"), **more).collect()), key=str)


@pytest.mark.parametrize(("postings", "words", "leaf"), [(10**6, 10**5, 48), (1500, 120, 4)])
def test_equals_brute_force(spark, monkeypatch, postings, words, leaf):
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "TERMS", words)
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    docs, items = made_up(3, 300)
    assert found(spark, docs, items) == brute_force(docs, items)
    assert found(spark, docs[:40], items, k=3) == brute_force(docs[:40], items, 3)


def test_trees_prune_and_stay_exact(monkeypatch):
    monkeypatch.setattr(lexical_search, "LEAF", 8)
    pick = np.random.default_rng(5)
    rows = []
    for topic in range(40):  # near copies of a few texts
        base = pick.choice(900, 30, replace=False)
        for _ in range(20):
            rows.append(np.unique(np.append(base, pick.choice(900, 3))))
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    columns = np.concatenate(rows)
    values = pick.integers(1, 10**9, 900)[columns] + pick.integers(0, 1000, len(columns))
    tree = lexical_search.BallTree(at, columns, values, 900)
    assert sorted(tree.order.tolist()) == list(range(len(rows)))
    dense = np.zeros((len(rows), 900), np.int64)
    dense[np.repeat(np.arange(len(rows)), np.diff(at)), columns] = values
    for ball in range(len(tree.low)):
        members = tree.order[tree.low[ball] : tree.high[ball]]
        item = rows[members[0]]
        q = np.zeros(900, np.int64)
        q[item] = 1
        assert (dense[members] @ q).max() <= tree._bound(ball, q)
    ids = np.arange(len(rows))
    scored = 0
    for r in range(0, len(rows), 20):
        item = rows[r][:25]
        best, n = tree.best(item, ids, 5, 0)
        scored += n
        q = np.zeros(900, np.int64)
        q[item] = 1
        assert sorted(best) == sorted((-int(s), i) for i, s in enumerate(dense @ q))[:5]
        assert tree.best(item, ids, 5, -best[-1][0] + 10**12)[0] == []
    assert scored < 0.5 * len(rows) * 40


def test_edges(spark):
    docs = [(i, "same words here") for i in range(500)] + [(9, "same words here"), (1000, "other")]
    got = found(spark, docs, [(1, "words"), (1, "words")])
    assert got == brute_force(docs, [(1, "words")]) and [r[2] for r in sorted(got, key=lambda r: r[1])] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert found(spark, [], [(1, "words")]) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], [(1, "a")]) == []
    clash = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id int, text string, block int, terms int")
    assert [tuple(r) for r in lexical_search.search(clash, spark.createDataFrame([(3, "b", 1)], "item_id long, text string, key int")).collect()] == brute_force([(1, "a b")], [(3, "b")])


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        want = con.execute(ORACLE["op12_lexical_search"]).fetchall()
    got = [tuple(r) for r in QUERIES["op12_lexical_search"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and len(got) == 10 * len({r[0] for r in got})
    ranks = defaultdict(list)
    for item, rank, *_ in got:
        ranks[item].append(rank)
    assert all(sorted(r) == list(range(1, len(r) + 1)) for r in ranks.values())
