import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orderlens.llm import speculative_bpe


@pytest.fixture(scope="module")
def library():
    reader = Tokenizer.from_file(public_tokenizers.path(speculative_bpe.VOCABULARY))
    reader.no_truncation()
    reader.no_padding()
    return reader


TEXTS = [
    None, "", " ", "\n\n  a\t b", "Hello world's  it'll 123abc", "é" * 50, "日本語 текст 🙂🙃", " 　x   y\x1c\x85", "a <|endoftext|> x <|endoftext|>",
    "<|endoftext|>", "<|endoftext|><|endoftext|>b  ", "<|endof<|endoftext|>text|>", "a" * 3000, " " * 1000, "word " * 40_000, "ß́ \x00\x01 \U0010ffff",
    "one\r\ntwo\n three \n", "x" * 70_000 + " tail 1", "-" * 501 + "=" * 77, "aaaaabaaaa ababab 'll 've's",
]


def test_ids_match_the_library(library):
    coder = speculative_bpe.SpeculativeBpe(speculative_bpe.VOCABULARY)
    for text in TEXTS:
        assert coder.encode(text or "") == library.encode(text or "", add_special_tokens=False).ids
    assert coder.exact > 0


def test_every_kind_of_character(library):
    coder = speculative_bpe.coder()
    for low in range(0, 0x110000, 61):
        if not 0xD800 <= low < 0xE000:
            c = chr(low)
            text = f"a{c}1 {c}b  {c} {c}{c} '{c}s"
            assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(low)


def test_random_words_need_both_ways(library):
    pick = random.Random(5)
    coder = speculative_bpe.SpeculativeBpe(speculative_bpe.VOCABULARY)
    letters = "etaoinshrdlu" * 4 + "bcfgkmpqvwxyzETAOIN0123456789éüß-_=."
    words = ["".join(pick.choice(letters) for _ in range(pick.randint(1, 14))) for _ in range(20_000)]
    words += ["".join(pick.choice("ab") for _ in range(pick.randint(1, 40))) for _ in range(2_000)]
    words = sorted({m for w in words for m in coder.matches(w)})
    got = coder.encode_words([w.encode() for w in words])
    assert 0 < coder.exact < len(words) / 2
    for word, ids in zip(words, got, strict=True):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == library.encode(word, add_special_tokens=False).ids, word
        assert ids == list(coder.merged(word.encode()))
    assert coder.merged_together([w.encode() for w in words]) == got


def test_pairs_are_judged_like_their_merges():
    coder = speculative_bpe.coder()
    pick = np.random.default_rng(3)
    plain = np.array(sorted(i for i in coder.usable if len(coder.table[i]) < 9))
    a, b = pick.choice(plain, 20_000), pick.choice(plain, 20_000)
    for x, y, apart in zip(a.tolist(), b.tolist(), coder.compatible(a, b).tolist(), strict=True):
        assert apart == (coder.merged(coder.table[x] + coder.table[y]) == (x, y))
    assert all(coder.merged(coder.table[i]) == (i,) for i in plain.tolist())


def test_memory_of_units_is_bounded(library, monkeypatch):
    monkeypatch.setattr(speculative_bpe, "REMEMBERED", 10)
    coder = speculative_bpe.SpeculativeBpe(speculative_bpe.VOCABULARY)
    for k in range(30):
        text = " ".join(f"w{k * i}" for i in range(8 + k)) + " same words here"
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert len(coder.known) <= 60 and len(coder.older) <= 60


def test_any_ids_decode_like_the_library(library):
    coder = speculative_bpe.coder()
    pick = random.Random(9)
    for _ in range(500):
        ids = [pick.randrange(coder.size) for _ in range(pick.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
        digests = speculative_bpe._Digests(coder)
        for i in ids:
            digests.add([i])
        assert digests.done()[2] == hashlib.sha256(coder.decode(ids).encode()).hexdigest()
    split = coder.encode("🙃日")
    assert len(split) > 2 and coder.decode(split[:1]) == "�" and coder.decode([coder.size + 5, -3]) == ""


def test_frame(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "y"), (4, TEXTS[4], "z")], "doc_id long, text string, n_tokens string")
    rows = speculative_bpe.encode_decode(docs, ids=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "a" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in speculative_bpe.decode_frame(speculative_bpe.encode_decode(docs, ids=True)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "a"}
    assert speculative_bpe.encode_decode(docs.limit(0)).count() == 0
