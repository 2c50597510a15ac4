import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orderlens.llm import maxent_lm
from orderlens.llm.textbytes import places, slots


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def brute(rows):
    count = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    out = []
    for d, x in rows:
        own = tokens(x)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        out.append((d, held(d), len(own), sum(count[t] > 0 for t in own), n, round(base, 6)))
    return sorted(out, key=str)


def corpus():
    rows = []
    for i in range(150):
        rows.append((i, " ".join(("the" if k % 3 == 0 else f"w{(i * k) % 40}" if k % 3 == 1 else f"rare{i}_{k}" if k % 11 == 0 else "Of") for k in range(60))))
    return rows + [(150, None), (151, ""), (152, " \n"), (153, "É é A a"), (None, "null id"), (7, rows[7][1])]


@pytest.mark.parametrize("head", [1 << 20, 64])
def test_base_matches_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(maxent_lm, "HEAD", head)  # with 64 most words take the join
    rows = corpus()
    got = maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows)
    out = [r for r in got if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)  # the model has learned from the history


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 2**63, 300).astype(np.uint64)
    counts = np.sort(rng.integers(1, 99, 300))[::-1].copy()
    singles = hashes[: maxent_lm.SINGLES]
    rest = hashes[maxent_lm.SINGLES :]
    cls = (rest % np.uint64(maxent_lm.SHARED)).astype(int)
    total = np.bincount(cls, counts[maxent_lm.SINGLES :], maxent_lm.SHARED)
    kinds = np.bincount(cls, minlength=maxent_lm.SHARED)
    vocab = maxent_lm.Vocabulary(hashes, counts, singles, int(counts.sum()), 300, total, kinds)
    weights = rng.normal(size=(maxent_lm.KINDS * maxent_lm.BUCKETS, maxent_lm.CLASSES)).astype(np.float32)
    log = maxent_lm.forward(weights, vocab.bias(), np.array([[5], [4100], [9000]]))[0]
    got, count = vocab.find(hashes)
    inside = np.where(got < maxent_lm.SINGLES, 1.0, (count + 0.5) / (total + 0.5 * (kinds + 1))[np.maximum(got - maxent_lm.SINGLES, 0)])
    unseen = (0.5 / (total + 0.5 * (kinds + 1)) * np.exp(log[maxent_lm.SINGLES :])).sum()  # one unseen word for each class
    assert abs((np.exp(log[got]) * inside).sum() + unseen - 1) < 1e-4


def drawn(seed, n=2000):
    rng = np.random.default_rng(seed)
    active = np.stack([np.minimum(rng.zipf(1.3, n), 900) + k * maxent_lm.BUCKETS for k in range(3)])
    return active, active[0] % 7, rng


def test_updates_raise_the_likelihood():
    active, cls, _ = drawn(2)
    bias = np.log((np.bincount(cls, minlength=maxent_lm.CLASSES) + 0.5) / (len(cls) + 0.5 * maxent_lm.CLASSES)).astype(np.float32)
    observed = np.zeros((3 * maxent_lm.BUCKETS, maxent_lm.CLASSES), np.int64)
    maxent_lm.add_observed(observed, active, cls)
    likelihood = lambda w: maxent_lm.forward(w, bias, active)[np.arange(len(cls)), cls].mean()
    w = maxent_lm.first_weights(observed, bias)
    seen = [likelihood(np.zeros_like(w)), likelihood(w)]
    for _ in range(6):
        expected = np.zeros_like(observed)
        for low in range(0, len(cls), 512):
            maxent_lm.add_expected(expected, w, bias, active[:, low : low + 512])
        w = maxent_lm.updated(w, observed, expected / maxent_lm.UNIT)
        seen.append(likelihood(w))
    assert all(a < b for a, b in zip(seen, seen[1:], strict=False))


def test_empty_table(spark):
    assert maxent_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sums_hold_every_occurrence():
    active, cls, rng = drawn(4, 1500)
    shape = 3 * maxent_lm.BUCKETS, maxent_lm.CLASSES
    w, b = rng.normal(size=shape).astype(np.float32), rng.normal(size=shape[1]).astype(np.float32)
    p = np.exp(maxent_lm.forward(w, b, active))
    want, seen = np.zeros(shape), np.zeros(shape, np.int64)
    for k in range(3):
        np.add.at(want, active[k], p)
        np.add.at(seen, (active[k], cls), 1)
    whole, cut, observed = (np.zeros(shape, np.int64) for _ in range(3))
    maxent_lm.add_expected(whole, w, b, active)
    for low, high in ((0, 7), (7, 900), (900, 1500)):
        maxent_lm.add_expected(cut, w, b, active[:, low:high])
    maxent_lm.add_observed(observed, active, cls)
    assert np.allclose(whole / maxent_lm.UNIT, want, atol=1e-2) and (whole == cut).all() and (observed == seen).all()


def plain_scores(rows):
    """The model by loops over tokens, with weights in double precision."""
    train = [tokens(x) for d, x in rows if not held(d)]
    def code(word):
        return int(maxent_lm.END) if word is None else int(maxent_lm.tokens(pa.array([word]))[0][0])
    count = Counter(t for own in train for t in own)
    ranked = sorted(count, key=lambda t: (-count[t], int(np.uint64(code(t)).view(np.int64))))
    single = {t: i for i, t in enumerate(ranked[: maxent_lm.SINGLES])}
    cls = lambda t: single.get(t, maxent_lm.SINGLES + code(t) % maxent_lm.SHARED)
    own, kinds = np.zeros(maxent_lm.CLASSES), np.zeros(maxent_lm.CLASSES)
    for t, n in count.items():
        own[cls(t)] += n
        kinds[cls(t)] += 1
    bias = np.log((own + 0.5) / (own.sum() + 0.5 * maxent_lm.CLASSES))
    bias[: maxent_lm.SINGLES][own[: maxent_lm.SINGLES] == 0] = -30
    def active(words):
        codes = np.array([code(t) for t in words], np.uint64)
        return maxent_lm.features(codes, np.array([0, len(codes)]))
    observed = np.zeros((3 * maxent_lm.BUCKETS, maxent_lm.CLASSES))
    for words in train:
        for k in range(3):
            np.add.at(observed, (active(words)[k], [cls(t) for t in words]), 1)
    plain = np.exp(bias) / np.exp(bias).sum()
    n = observed.sum(1, keepdims=True)
    w = maxent_lm.START_SHARE * np.log((observed + maxent_lm.PRIOR * plain) / ((n + maxent_lm.PRIOR) * plain))
    def log(words):
        z = w[active(words)].sum(0) + bias
        return z - np.log(np.exp(z).sum(1, keepdims=True))
    for _ in range(maxent_lm.ROUNDS):
        expected = np.zeros_like(observed)
        for words in train:
            p = np.exp(log(words))
            for k in range(3):
                np.add.at(expected, active(words)[k], p)
        w = w + maxent_lm.RATE * (observed - expected) / (np.maximum(observed, expected) + maxent_lm.PRIOR)
    out = []
    for d, x in rows:
        words, total = tokens(x), 0.0
        for t, z in zip(words, log(tokens(x)), strict=True):
            c = cls(t)
            total += z[c] / math.log(10)
            if c >= maxent_lm.SINGLES:
                total += math.log10((count[t] + 0.5) / (own[c] + 0.5 * (kinds[c] + 1)))
        out.append((str(d), total))
    return sorted(out)


def test_score_is_that_of_a_plain_model_and_does_not_depend_on_the_split(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted((str(r.doc_id), r.score) for r in maxent_lm.score(df.repartition(parts)).collect()) for parts in (1, 13)]
    want = plain_scores(rows)
    assert [d for d, _ in want] == [d for d, _ in runs[0]] == [d for d, _ in runs[1]]
    assert [x for _, x in runs[0]] == pytest.approx([x for _, x in runs[1]], abs=1e-9)
    assert [x for _, x in runs[0]] == pytest.approx([x for _, x in want], abs=2e-2)


def test_equal_histories_are_counted_as_often_as_they_occur(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "TOGETHER", 700)
    monkeypatch.setattr(maxent_lm, "TOGETHER_ROW", 64)
    texts = [f"the w{i % 5} of the w{i % 3} Of" for i in range(200)] + ["", None, "the the the the"]
    df = spark.createDataFrame([(t or "",) for t in texts], "text string").repartition(3)
    _, vocab = maxent_lm.vocabulary(df)
    known = spark.sparkContext.broadcast(vocab)
    seen = maxent_lm.histories(df, known)
    token, at = maxent_lm.tokens(pa.array([t or "" for t in texts]))
    active, cls = maxent_lm.features(token, at), vocab.find(token)[0]
    assert (maxent_lm.features_of(maxent_lm.coded(active, cls) // maxent_lm.CLASSES) == active).all()
    assert sum(np.frombuffer(r.n, np.int64).sum() for r in seen.collect()) == len(token)
    w = np.random.default_rng(3).normal(size=(3 * maxent_lm.BUCKETS, maxent_lm.CLASSES)).astype(np.float32)
    observed, expected = np.zeros(w.shape, np.int64), np.zeros(w.shape, np.int64)
    maxent_lm.add_observed(observed, active, cls)
    maxent_lm.add_expected(expected, w, vocab.bias(), active)
    assert (maxent_lm.summed(seen, None) == observed).all()
    assert (maxent_lm.summed(seen, spark.sparkContext.broadcast((w, vocab.bias()))) == expected).all()


def test_training_goes_on_after_the_first_update(spark, monkeypatch):
    passes = []
    inner = maxent_lm.updated
    monkeypatch.setattr(maxent_lm, "updated", lambda *given: (passes.append(1), inner(*given))[1])
    rows = corpus()
    got = maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(passes) == maxent_lm.ROUNDS > 1
    monkeypatch.setattr(maxent_lm, "ROUNDS", 1)
    once = maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.score for r in got if not r.held_out) > sum(r.score for r in once if not r.held_out)


def test_products_of_powers_are_the_softmax(monkeypatch):
    monkeypatch.setattr(maxent_lm, "ABREAST", 64)
    active, _, rng = drawn(6, 500)
    cls = rng.integers(0, maxent_lm.CLASSES, 500)
    w = rng.normal(size=(3 * maxent_lm.BUCKETS, maxent_lm.CLASSES)).astype(np.float32)
    b = rng.normal(size=maxent_lm.CLASSES).astype(np.float32)
    got = maxent_lm.log_shares(w, b, maxent_lm.powers(w, b), active, cls)
    assert np.allclose(got, maxent_lm.forward(w, b, active)[np.arange(500), cls], atol=1e-5)


def test_sums_by_row_are_exact_for_rare_and_frequent_rows(monkeypatch):
    monkeypatch.setattr(maxent_lm, "RUN", 16)
    rng = np.random.default_rng(8)
    for row in (rng.zipf(1.2, 3000).clip(0, 400), np.sort(rng.integers(0, 9, 3000)), np.arange(3000)):
        share, want = rng.integers(0, maxent_lm.UNIT, (3000, 4)).astype(np.int32), np.zeros((3000, 4), np.int64)
        got = want.copy()
        np.add.at(want, row, share)
        maxent_lm.add_by_row(got, share, row)
        assert (got == want).all()
    times, (active, _, _) = rng.integers(1, 9000, 2000), drawn(9)
    w, once, many = rng.normal(size=(3 * maxent_lm.BUCKETS, maxent_lm.CLASSES)), *(np.zeros((3 * maxent_lm.BUCKETS, maxent_lm.CLASSES), np.int64) for _ in range(2))
    power = maxent_lm.powers(w.astype(np.float32), np.zeros(maxent_lm.CLASSES, np.float32))
    maxent_lm.add_shares(once, power, active[:, :1])
    maxent_lm.add_shares(many, power, np.repeat(active[:, :1], 2000, 1), times)
    assert (many == once * times.sum()).all()


def test_packed_codes_come_back():
    code = np.sort(np.random.default_rng(5).integers(0, maxent_lm.BUCKETS**3 * maxent_lm.CLASSES, 999))
    assert (maxent_lm.unpacked(pa.py_buffer(maxent_lm.packed(code))) == code).all()


def test_places_are_those_of_bisection():
    rng = np.random.default_rng(4)
    near = np.array([0, 1, 2, 3, 2**63 - 1, 2**63, 2**63 + 1, 2**64 - 1], np.uint64)
    for known in (near[:0], near[:1], near[-1:], near[1:4], np.unique(rng.integers(0, 2**64, 999, dtype=np.uint64))):
        asked = np.concatenate((near, known, rng.integers(0, 2**64, 999, dtype=np.uint64)))
        assert (places(known, slots(known), asked) == np.searchsorted(known, asked)).all()
