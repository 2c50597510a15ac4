"""Byte-level BPE: ids, offsets and decoding.

The ranks file of a public tokenizer gives the vocabulary. Each match of the pattern is
encoded on its own by the ``tokenizers`` library, whose model works on characters; so bytes
are written as the 256 printable characters of byte-level BPE first. As a match's ids depend
on nothing but the match, each distinct match is handed to the library once, and a bounded
memory of the worker keeps the ids of frequent words with the punctuation around them.

Defined cases: a null text is an empty one and has no ids; any characters are encoded, as
every byte has a token; decoding joins bytes before it reads characters, so characters that
are split over tokens come back whole. Rows are independent: ties, repeated rows and extra
columns don't matter. Texts are cut into pieces of about 64 KB where a space follows another
character (the pattern never matches across such a place), so a very long text needs memory
for its ids but not for the library's records of them.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

from orderlens.llm.common import in_arrow, text_or_empty
from orderlens.llm.textbytes import joined, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct units that a worker remembers, and the longest one worth it.
REMEMBERED, LONGEST = 300_000, 64
PIECE = 1 << 16
#: White space as the pattern's engine reads it: a fixed class of Unicode.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match holds a white-space character after another one, so these units hold whole matches.
_UNITS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself if it has one, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def merge_of(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes ``token``: what is left of its bytes by earlier merges."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
        if ranks.get(parts[at] + parts[at + 1], rank) >= rank:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class ByteBpe:
    """Encoder and decoder over one ranks file."""

    def __init__(self, file: str):
        with open(public_tokenizers.path(file), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        char = byte_characters()
        shown = {t: "".join(char[b] for b in t) for t in ranks}
        pairs = (merge_of(t, r, ranks) for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1)
        model = models.BPE({shown[t]: r for t, r in ranks.items()}, [(shown[a], shown[b]) for a, b in filter(None, pairs)], ignore_merges=True)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        size = max(ranks.values(), default=-1) + 1
        self.length = np.zeros(size, np.int64)
        table = [b""] * size
        for t, r in ranks.items():
            table[r], self.length[r] = t, len(t)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.known: dict[str, bytes] = {}  # ids as unsigned 32-bit integers

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of these units: their matches go to the library, each one once."""
        split = {u: self.matches(u) for u in units}
        each = list({m for found in split.values() for m in found})
        ids = dict(zip(each, (np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(each, add_special_tokens=False)), strict=True))
        return {u: b"".join(map(ids.__getitem__, found)) for u, found in split.items()}

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
                end = cut.start()
            units = _UNITS.findall(text[at:end])
            known = self.known
            if new := {u for u in units if u not in known}:
                learnt = self._learn(new)
                if len(known) + len(learnt) > REMEMBERED:
                    learnt |= {u: known[u] for u in units if u in known}
                    known.clear()
                known |= {u: x for u, x in learnt.items() if len(u) <= LONGEST}
                if any(len(u) > LONGEST for u in new):
                    known = known | learnt
            out.append(np.frombuffer(b"".join(map(known.__getitem__, units)), "<u4"))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' tokens, joined."""
        n = self.length[ids]
        begin = np.cumsum(n) - n
        return self.bytes[np.arange(int(n.sum())) + np.repeat(self.start[ids] - begin, n)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no character (cut off at an end) become U+FFFD."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of each token, in characters of the text.

        A character belongs to every token that holds one of its bytes, so a token that holds
        only later bytes of a character starts at that character too.
        """
        n = self.length[ids]
        data = self.decode_bytes(ids)
        seen = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters begun before each byte
        end = np.cumsum(n)
        begin = end - n
        later = np.append((data & 0xC0) == 0x80, False)[begin] if len(ids) else np.zeros(0, bool)
        return seen[begin] - later, seen[end]


@cache
def coder(file: str = VOCABULARY) -> ByteBpe:
    """One encoder for each worker process; the library's own threads stay off, as Spark runs the tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(file)


def encode_decode(df: DataFrame, column: str = "text", file: str = VOCABULARY, ids: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (integers or strings) and the encoding of every text.

    Adds n_tokens, ids_sha256 (over little-endian unsigned 32-bit ids), decoded_sha256 (over
    the bytes that the ids decode to) and, if asked for, the ids themselves as ``token_ids``.
    """
    chosen = df.select(*keep, text_or_empty(column).alias("_bpe_text"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(file)
        for whole in batches:
            for batch in slices(whole, "_bpe_text"):
                done = [bpe.encode(t) for t in batch.column("_bpe_text").to_pylist()]
                columns = [batch.column(c) for c in keep] + [
                    pa.array([len(x) for x in done], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in done], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode_bytes(x).tobytes()).hexdigest() for x in done], pa.string()),
                ]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    at = np.concatenate(([0], np.cumsum([len(x) for x in done])))
                    flat = np.concatenate(done).astype(np.int32) if done else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return in_arrow(chosen, work, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids)


def decode_frame(df: DataFrame, column: str = "token_ids", file: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``text``, decoded from a column of ids; null ids give an empty text."""
    chosen = df.select(*keep, column)
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(file)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return in_arrow(chosen, work, f"{schema}, text string")
