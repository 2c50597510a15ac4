import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from orderlens.llm import bpe


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None, "", " ", "\n\n  a\t b", "Hello world's  it'll 123abc", "é" * 50, "日本語 текст 🙂🙃", " 　x   y\x1c\x85", "<|endoftext|> x",
    "a" * 3000, " " * 1000, "word " * 40_000, "ß́ \x00\x01 \U0010ffff", "one\r\ntwo\n three \n", "x" * 70_000 + " tail 1",
]


def test_ids_match_the_reference_library(reference):
    coder = bpe.ByteBpe(bpe.VOCABULARY)
    for text in TEXTS:
        assert coder.encode(text or "").tolist() == reference.encode_ordinary(text or "")


def test_every_character(reference):
    coder = bpe.coder()
    for low in range(0, 0x110000, 61):
        if not 0xD800 <= low < 0xE000:
            c = chr(low)
            text = f"a{c}1 {c}b  {c} {c}{c} '{c}s"
            assert coder.encode(text).tolist() == reference.encode_ordinary(text), hex(low)


def test_memory_of_units_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    coder = bpe.ByteBpe(bpe.VOCABULARY)
    for k in range(30):
        text = " ".join(f"w{k * i}" for i in range(8)) + " same words here"
        assert coder.encode(text).tolist() == reference.encode_ordinary(text)
        assert len(coder.known) <= 20


def test_round_trip_and_spans():
    coder = bpe.coder()
    for text in TEXTS:
        text = text or ""
        ids = coder.encode(text).astype(np.int64)
        assert coder.decode(ids) == text
        begin, end = coder.spans(ids)
        whole = text.encode()
        at = 0
        for i, b, e in zip(ids[:500], begin, end, strict=False):
            stop = at + int(coder.length[i])
            first = len(whole[:at].decode("utf-8", "ignore"))
            assert b == first and e == len(whole[:stop].decode("utf-8", "replace")) if (whole + b" ")[stop] & 0xC0 != 0x80 else e >= b
            at = stop
    split = coder.encode("🙃日").astype(np.int64)
    assert len(split) > 2 and coder.decode(split[:1]) == "�"


def test_frame(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "y"), (4, TEXTS[4], "z")], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_decode(docs, ids=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "a" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode_frame(bpe.encode_decode(docs, ids=True)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "a"}
    assert bpe.encode_decode(docs.limit(0)).count() == 0
