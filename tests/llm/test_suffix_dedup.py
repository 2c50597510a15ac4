import hashlib
import random

import pytest

from orderlens.llm import suffix_dedup
from orderlens.llm.suffix_array import suffix_array


@pytest.mark.parametrize("letters", [1, 2, 5, 300])
def test_suffix_array_matches_sorting(letters):
    draw = random.Random(letters)
    for n in range(60):
        line = [draw.randrange(letters) for _ in range(n)]
        line = (line[: n // 4 + 1] * 4)[:n] if n % 3 == 0 else line
        assert suffix_array(line) == sorted(range(n), key=lambda i: line[i:])


def brute(rows):
    """Every window in order of document and start; a set of those seen before."""
    seen, out = set(), {}
    for d, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[(d, text)] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return sorted(((d, *out[(d, t)]) for d, t in rows), key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in suffix_dedup.removed_bytes(docs).collect()), key=str)


def corpus(seed):
    draw = random.Random(seed)

    def prose(n):
        return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9))) for _ in range(n))

    shared = [prose(k) for k in (15, 18, 30, 60, 200)]
    texts = []
    for _ in range(50):
        parts = [prose(draw.randint(0, 60)), draw.choice(shared), prose(draw.randint(0, 30))]
        if draw.random() < 0.5:
            passage = draw.choice(shared)
            cut = draw.randint(0, len(passage) // 2)
            parts.append(passage[cut:])
        draw.shuffle(parts)
        texts.append("".join(parts))
    texts += [texts[3], texts[7], "x" * 350, "xy" * 120, "x" * 99, "x" * 100, "", None, prose(900), shared[4][:100], shared[4][1:101]]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_frequent_anchors_take_the_other_way(spark, monkeypatch):
    line = "".join(chr(97 + i * 7 % 26) for i in range(60))
    rows = [(i, f"{i * 7919 % 9973:060d}{line}{i * 31 % 997:060d}") for i in range(40)]
    rows += [(100 + i, f"{i % 3:030d}{line}{i % 2:040d}") for i in range(12)]
    want = brute(rows)
    assert run(spark, rows) == want
    # the limit is read inside the tasks, so the streaming step is called directly
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "MANY", 3)
    n = np.array([[1, 1, 1, 1, 1, 2, 2, 3], [1, 2, 3, 4, 4, 1, 2, 9], [0, 1, 2, 3, 4, 5, 6, 7], [0] * 8], np.int64)
    batches = [pa.RecordBatch.from_arrays([*(pa.array(n[k, i : i + 2]) for k in range(4)), pa.array([2] * 2, pa.int32())], ["h", "c", "d", "at", "kind"]) for i in range(0, 8, 2)]
    got = sorted((r["d"], r["kind"]) for b in suffix_dedup.after_first(iter(batches)) for r in b.to_pylist())
    assert got == [(0, 3), (1, 3), (2, 3), (3, 3), (4, 1), (5, 2), (6, 2)]


def test_all_windows_by_their_own_hash(spark, monkeypatch):
    import orderlens.llm.suffix_dedup as s

    rows = [(i, t) for i, t in corpus(5) if t]
    monkeypatch.setattr(s, "FIRST", 99)  # the plan sends kind 99 to the suffix array: none
    monkeypatch.setattr(s, "FIRST_OF_MANY", 2)  # and all first contexts to single windows
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    rows = [(4, text), (4, text), (None, text[:250]), (9, text[100:]), (2, "short"), (None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_many_texts_of_one_id(spark):
    draw = random.Random(21)
    texts = ["".join(draw.choice("abcdefghijklmnop") for _ in range(150)) for _ in range(3000)]
    pairs = [(t, f"{t}{i:08d}") for i, t in enumerate(texts[:1500])]
    rows = [(None, t) for t in texts] + [(None, b) for _, b in pairs]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {}
    for r in suffix_dedup.without_repeats(docs.withColumn("same", docs.text)).collect():
        left[r.same] = r.text
    assert len(left) == len(rows) and all(left[t] == t for t in texts[1500:])
    # of two texts with a common string one keeps it, whichever comes first by its hash
    assert all((left[a], left[b]) in ((a, b[150:]), ("", b)) for a, b in pairs)


def test_long_text_in_pieces():
    import numpy as np

    data = np.frombuffer(random.Random(3).randbytes(5000) * 3, np.uint8)
    whole, _ = suffix_dedup.anchors(data, np.array([0, len(data)]))
    parts = [suffix_dedup.anchors(data[a : a + 1000 + 99], np.array([0, len(data[a : a + 1099])]))[0] + a for a in range(0, len(data) - 99, 1000)]
    assert np.array_equal(np.unique(np.concatenate(parts)), whole)


def test_stage_keeps_rows_and_columns(spark):
    draw = random.Random(9)
    text = "".join(draw.choice("abcdefgh ") for _ in range(300))
    docs = spark.createDataFrame([(1, text, "a", 300), (2, "né " + text, "b", 303), (3, None, None, None)], "doc_id long, text string, d string, n_chars long")
    rows = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert rows[1].text == text and rows[2].text == "né " and rows[2].n_chars == 3 and rows[2].d == "b" and rows[3].text is None
