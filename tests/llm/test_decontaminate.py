import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa

from orderlens.llm import decontaminate as d

SF = "/root/testdata/sf0.01"


def plain(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_matches_the_table():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.randrange(6) for _ in range(draw.randint(0, 90))] for _ in range(2))
        assert d.lcs_length(a, b) == lcs(a, b)


def test_recall_against_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in d.leaked(docs, items).collect()}
    want = set()
    asked = [(r.item_id, plain(r.text)) for r in items.collect()]
    for row, (item, own) in product(((r.doc_id, plain(r.text)) for r in docs.collect()), asked):
        doc, words = row
        if len(own) < d.SHORTEST:
            if own and any(words[s : s + len(own)] == own for s in range(len(words))):
                want.add((doc, item))
            continue
        if len(set(own) & set(words)) < d.SAME * len(set(own)) / 2:
            continue
        span = len(own) + len(own) // 4 + 8
        if any(d.lcs_length(own, words[s : s + span]) >= d.SAME * len(own) for s in range(0, max(len(words), 1), 8)):
            want.add((doc, item))
    assert len(want) > 10 and len(want & got) >= 0.95 * len(want)
    # whatever else is reported rests on an answer, or on a run the brute force's steps cut
    extra = {(r.doc_id, r.item_id): r for r in d.leaked(docs, items).collect() if (r.doc_id, r.item_id) not in want}
    assert all(r.answered or r.common_words >= d.SAME * r.item_words for r in extra.values())


def test_planted_changed_and_clean(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(12 + 4 * i)) + ". " + " ".join(word() for _ in range(4)) + ".") for i in range(10)]
    docs = []
    for i, (_, text) in enumerate(items):
        own = text.split()
        changed = [word() if k % 9 == 4 else w for k, w in enumerate(own)]
        far = [word() if k % 3 == 1 and k < len(own) - 4 else w for k, w in enumerate(own)]
        for j, part in enumerate((own, changed, far)):
            lead = [word() for _ in range(draw.randint(0, 200))]
            docs.append((10 * i + j, " ".join([*lead, *part, *(word() for _ in range(draw.randint(0, 100)))])))
    docs += [(500 + k, " ".join(word() for _ in range(300))) for k in range(30)] + [(900, None), (901, ""), (None, items[4][1]), (0, docs[0][1])]
    found = d.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "too short")], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert {(10 * i + j, i) for i in range(10) for j in (0, 1)} | {(None, 4)} <= got
    assert all(i is None or i < 500 and k == i // 10 for i, k in got) and len(found) == len(got) + 1  # the repeated row


def test_copies_whose_rarest_words_are_changed(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [plain(r.text) for r in docs.collect()]
    frequency = Counter(w for own in texts for w in set(own))
    asked = [(r.item_id, plain(r.text)) for r in items.collect()]
    planted = []
    for item, own in asked:
        rare = sorted(range(len(own)), key=lambda i: frequency[own[i]])[: len(own) // 5]
        copy = [f"changed{i}" if i in rare else w for i, w in enumerate(own)]
        planted.append((1_000_000 + item, " ".join([*texts[item][:100], *copy, *texts[item][100:200]])))
    both = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    got = {(r.doc_id, r.item_id) for r in d.leaked(both, items).collect()}
    assert {(1_000_000 + item, item) for item, own in asked if len(own) >= d.SHORTEST} <= got  # shorter ones must be whole


def test_shared_words_bound_the_common_subsequence():
    draw = random.Random(8)
    word = [f"w{k}" for k in range(30)]
    texts = [" ".join(draw.choice(word) for _ in range(n)) for n in (5, 9, 17, 40, 90)]
    idf, space = np.ones(d.BUCKETS, np.float32), np.random.default_rng(1).standard_normal((d.BUCKETS, d.RANK)).astype(np.float32)
    searcher = d.Searcher(list(range(5)), texts, idf, space)
    rows = pa.array([" ".join(draw.choice(word) for _ in range(draw.randint(0, 60))) + " " + " ".join(w for w in draw.choice(texts).split() if draw.random() < 0.9) for _ in range(60)])
    hashes, bounds = d.plain_words(rows)
    got = searcher.leaks(hashes, bounds)
    for t in range(60):
        here = hashes[bounds[t] : bounds[t + 1]].tolist()
        for k, own in enumerate(searcher.words):
            blocks = -(-len(own) // d.BLOCK) + 1
            starts = [s for s in range(0, max(len(here), 1), d.BLOCK) if s == 0 or s // d.BLOCK + blocks <= -(-len(here) // d.BLOCK)]
            most = max(lcs(own, here[max(s - d.BLOCK, 0) : s + (blocks + 1) * d.BLOCK]) for s in starts)
            assert most < d.SAME * len(own) or k in got.get(t, {})


def test_paraphrases_with_short_answers(monkeypatch):
    monkeypatch.setattr(d, "COSINE", -1.0)  # the answer rule by itself
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8)))
    items, docs = [], []
    for i in range(12):
        body, answer = [word() for _ in range(24 + i)], [word() for _ in range(1 + i % 2)]
        items.append((i, f"{' '.join(body)}? {' '.join(answer)}."))
        loose = [word() if k % 10 in (2, 5, 8) else w for k, w in enumerate(body)]  # 70% of the words are left
        lead, gap, rest = ([word() for _ in range(n)] for n in (draw.randint(0, 40), 6, 40))
        docs.append((10 * i, " ".join([*lead, *loose, *answer, *rest])))
        docs.append((10 * i + 1, " ".join([*lead, *loose, *rest])))  # without the answer
        docs.append((10 * i + 2, " ".join([*lead, *loose, *gap, *answer, *rest])))  # it stands there by chance
    idf, space = np.ones(d.BUCKETS, np.float32), np.random.default_rng(1).standard_normal((d.BUCKETS, d.RANK)).astype(np.float32)
    found = d.Searcher([i for i, _ in items], [t for _, t in items], idf, space).leaks(*d.plain_words(pa.array([t for _, t in docs])))
    assert {(docs[t][0], k) for t, own in found.items() for k in own} == {(10 * i, i) for i in range(12)}
    assert all(answered for own in found.values() for _, answered, _ in own.values())


def test_items_of_few_words(spark):
    draw = random.Random(21)
    items = [(k, " ".join(draw.choice("abcdef") for _ in range(1 + k % 4)) + "!") for k in range(30)] + [(100, "... ?"), (101, "A b C d")]
    docs = [(i, " ".join(draw.choice("abcdefghijkl") for _ in range(draw.randint(0, 9)))) for i in range(80)] + [(None, None), (200, "x A, b. C d"), (201, "a b c"), (202, "d")]
    found = d.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, *items[:9], (0, "a whole item of six words")], "item_id long, text string"))
    want = Counter()
    for (doc, text), (item, asked) in product(docs, set(items)):
        own, here = plain(asked), plain(text)
        if own and any(here[s : s + len(own)] == own for s in range(len(here))):
            want[doc, item] += 1
    rows = found.collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == want and (200, 101) in want
    assert all(r.common_words == r.item_words < d.SHORTEST for r in rows)


def test_groups_of_items_hold_equal_rows_once(spark, monkeypatch):
    monkeypatch.setattr(d, "ITEMS", 3)
    text = "seven plain words that stand here alone"
    items = spark.createDataFrame([(1, text)] * 50 + [(k, f"{text} with {k}") for k in range(2, 9)], "item_id long, text string")
    seen = []
    inner = d.Searcher.__init__
    monkeypatch.setattr(d.Searcher, "__init__", lambda self, ids, texts, *rest: (seen.append(len(ids)), inner(self, ids, texts, *rest))[1])
    docs = spark.createDataFrame([(1, f"before it {text} and more of it")], "doc_id long, text string")
    assert (1, 1) in {(r.doc_id, r.item_id) for r in d.leaked(docs, items).collect()}
    assert sum(seen) == 8 and len(seen) == 3


def test_empty_tables_and_columns(spark):
    docs = spark.createDataFrame([(1, "some words that stand here alone", 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, "some words that stand here alone")], "item_id long, text string")
    assert d.leaked(docs, items.limit(0)).count() == 0 and d.leaked(docs.limit(0), items).count() == 0
    assert d.drop_leaked(docs, items.limit(0)).collect() == docs.collect()
    assert d.drop_leaked(docs, items).count() == 0


def test_directions_are_fitted_on_every_passage(spark):
    draw = random.Random(31)
    texts = [" ".join(f"w{draw.randrange(900)}" for _ in range(draw.randint(0, 200))) for _ in range(60)]
    rows = [(t, 1) for t in [*texts, *texts[:20]]] + [("an item of its own", 0), ("", 1)]
    known = d.featured(spark.createDataFrame(rows, "text string, n int"))
    df, n = d.document_frequencies(known)
    hashed = [d.buckets(d.plain_words(pa.array([t]))[0]) for t, _ in rows]
    want = np.zeros(d.BUCKETS, np.int64)
    for own, (_, k) in zip(hashed, rows, strict=True):
        want[np.unique(own)] += k
    assert n == 81 and (df == want).all()
    idf = np.log((n + 1) / (df + 0.5)).clip(0.1).astype(np.float32)
    matrix = []
    for own in hashed[:60] + hashed[80:81]:  # equal texts count once
        for k in range(0, len(own), d.PASSAGE):
            row = np.bincount(own[k : k + d.PASSAGE], idf[own[k : k + d.PASSAGE]], d.BUCKETS)
            matrix.append(row / np.sqrt((idf[own[k : k + d.PASSAGE]].astype(float) ** 2).sum()))
    a, basis = np.array(matrix), np.random.default_rng(1).standard_normal((d.BUCKETS, 5)).astype(np.float32)
    assert np.allclose(d._summed(known, idf, basis, False), a.T @ (a @ basis), atol=1e-3)
    assert np.allclose(d._summed(known, idf, basis, True), (a @ basis).T @ (a @ basis), atol=1e-2)


def test_many_documents_leave_none_out(spark, monkeypatch):
    """The directions see more passages than the 20,000 that were once sampled."""
    seen = []
    inner = d.directions
    monkeypatch.setattr(d, "directions", lambda texts, idf: (seen.append(sum(-(-len(r.features) // 2 // d.PASSAGE) for r in texts.collect())), inner(texts, idf))[1])
    docs = spark.range(21_000).selectExpr("id AS doc_id", "concat('document number ', id, ' holds few words') AS text")
    items = spark.createDataFrame([(1, "document number 20999 holds few words"), (2, None)], "item_id long, text string")
    assert 1 in {r.item_id for r in d.leaked(docs, items).collect()}
    assert seen == [21_000]  # the item equals a document's text


def test_sums_and_products_are_those_of_plain_loops(monkeypatch):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 9, (90, 4)).astype(np.uint8)
    for size in (*range(1, 18), 90):
        want = np.array([rows[i : i + size].sum(0) for i in range(91 - size)])
        assert (d.sums_from(rows.astype(np.uint16), size) == want).all()
    least = np.array([3, 8, 9, 0], np.uint8)
    for n in (0, 5, 64, 90):
        assert (d.reached(rows[:n], least) == np.flatnonzero(rows[:n] >= least)).all()
    # features that are frequent among the passages taken together, and others
    monkeypatch.setattr(d, "TOGETHER", 7)
    bounds = np.cumsum([0, 500, 0, 3, 1, 700, 48])
    bucket = np.where(rng.random(bounds[-1]) < 0.5, rng.integers(0, 3, bounds[-1]), rng.integers(0, d.BUCKETS, bounds[-1]))
    idf, basis = rng.uniform(0.1, 5, d.BUCKETS).astype(np.float32), rng.standard_normal((d.BUCKETS, 6)).astype(np.float32)
    passage, weight = d.passages(bucket, bounds, idf)
    a = np.zeros((passage[-1] + 1, d.BUCKETS))
    np.add.at(a, (passage, bucket), idf[bucket] * weight[passage])
    assert passage[-1] + 1 == 11 + 1 + 1 + 15 + 1
    for frequent in (1, 12, 10_000):
        monkeypatch.setattr(d, "FREQUENT", frequent)
        for gram, want in ((True, (a @ basis).T @ (a @ basis)), (False, a.T @ (a @ basis))):
            total = np.zeros(want.shape, np.float32)
            d.add_products(total, basis * idf[:, None], bucket, passage, weight, gram)
            assert np.allclose(total if gram else total * idf[:, None], want, rtol=1e-3, atol=1e-2)


def test_small_items_and_long_ones_at_the_ends_of_texts():
    word = [f"w{k}" for k in range(700)]
    texts = [" ".join(word[:5]), " ".join(word[100:400]), " ".join(word[400:408])]  # sums beyond 255 for the second one
    idf, space = np.ones(d.BUCKETS, np.float32), np.random.default_rng(1).standard_normal((d.BUCKETS, d.RANK)).astype(np.float32)
    searcher = d.Searcher([0, 1, 2], texts, idf, space)
    rows = ["", texts[0], "x " * 13 + texts[1], texts[2] + " x" * 40, "x y " + texts[0], texts[0][:5], "", texts[1] + " " + texts[2]]
    got = searcher.leaks(*d.plain_words(pa.array(rows)))
    assert {t: set(own) for t, own in got.items()} == {1: {0}, 2: {1}, 3: {2}, 4: {0}, 7: {1, 2}}
