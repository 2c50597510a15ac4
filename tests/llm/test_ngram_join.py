import random
import time
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from orderlens.llm import ngram_join


def shingles(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    links = defaultdict(set)
    for (i, (_, a)), (j, (_, b)) in combinations(enumerate(sets), 2):
        if a and b and 5 * len(a & b) >= 4 * len(a | b):
            links[i].add(j)
            links[j].add(i)
    root = {}
    for i in range(len(sets)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        root[i] = min((sets[j][0] for j in seen), key=lambda d: (d is not None, d))
    return sorted(((d, root[i], len(links[i])) for i, (d, _) in enumerate(sets)), key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()), key=str)


def family(n, base, edits):
    words = [f"w{base}_{i}" for i in range(60)]
    out = []
    for k in range(n):
        own = list(words)
        for e in range(k % edits):
            own[(k * 7 + e * 13) % 60] = f"x{k}_{e}"
        out.append(" ".join(own))
    return out


def test_matches_brute_force(spark):
    texts = family(12, "a", 2) + family(9, "b", 3) + family(40, "c", 2) + ["one two", "one two", "one  two", "", None, " \n", "a b c d e"]
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    rows = list(enumerate(family(40, "c", 2) + family(7, "d", 1)))
    whole = run(spark, rows)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    assert run(spark, rows) == whole == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = family(1, "z", 1)[0]
    rows = [(5, text), (5, text), (None, text), (7, "other words that stand quite alone here"), (7, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_one_row_of_each_group_stays(spark):
    rows = [(i, t, "k") for i, t in enumerate(family(12, "a", 2) + ["", "one two", "one two", ""])]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, keeper string")
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute([(d, t) for d, t, _ in rows])})


@pytest.mark.parametrize("n", [1, 3])
def test_bands_meet_the_target(n):
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** ngram_join.BANDS > 0.999


def test_thousands_of_texts_without_an_id(spark):
    pick = random.Random(11)
    texts = []
    for _ in range(1500):  # pairs of near copies
        words = [f"w{pick.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(words + ["more"])]
    named = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    nameless = named.select(F.lit(None).cast("long").alias("doc_id"), "text")
    shared = named.select(F.lit(7).cast("long").alias("doc_id"), "text")
    want = near_duplicates_count(named)
    assert want == {1: 3000}
    seconds = []
    for frame in (named, nameless, shared):
        start = time.perf_counter()
        assert near_duplicates_count(frame) == want
        seconds.append(time.perf_counter() - start)
    assert max(seconds[1:]) < 3 * seconds[0] + 5
    assert ngram_join.drop_near_duplicates(nameless).count() == 1500


def near_duplicates_count(frame):
    return {r["n_links"]: r["count"] for r in ngram_join.near_duplicates(frame).groupBy("n_links").count().collect()}
