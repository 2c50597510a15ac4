"""Tokens of each section of a text, from one encoding of the whole text.

Sections are character spans ``(section, start, stop)`` of one text, ascending and not
overlapping; characters between them belong to no section. The text is encoded once, the
tokens' character spans are joined to the sections by searching the sorted bounds, and a
token that touches several sections is given by a rule:

``majority``  to the section that holds most of its characters, the earlier one in a tie;
``first``     to the section of its first character that lies in one;
``shared``    in equal parts per character, as a fraction of a token to each.

Defined cases: null and empty texts have no sections; an empty section has 0 tokens; a
token outside all sections counts only in ``text_tokens``. Repeated rows give repeated
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.bpe import VOCABULARY, coder
from orderlens.llm.common import in_arrow, text_or_empty
from orderlens.llm.textbytes import slices

RULES = ("majority", "first", "shared")


def attribute(begin: np.ndarray, end: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of the tokens that touch it touch another one too.

    ``begin``/``end`` ascend with the tokens and ``start``/``stop`` with the sections.
    """
    total, crossing = np.zeros(len(start)), np.zeros(len(start), np.int64)
    if not len(start) or not len(begin):
        return total, crossing
    low = np.searchsorted(stop, begin, "right")  # first section that ends after the token begins
    high = np.searchsorted(start, end, "left")  # first section that starts at or after its end
    touch = np.maximum(high - low, 0)
    token = np.repeat(np.arange(len(begin)), touch)
    section = np.arange(len(token)) - np.repeat(np.cumsum(touch) - touch, touch) + np.repeat(low, touch)
    shared = np.minimum(end[token], stop[section]) - np.maximum(begin[token], start[section])
    token, section, shared = (x[shared > 0] for x in (token, section, shared))
    if not len(token):
        return total, crossing
    head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    size = np.diff(np.append(head, len(token)))
    crossing += np.bincount(section[np.repeat(size > 1, size)], minlength=len(start))
    if rule == "shared":
        part = shared / np.repeat(np.add.reduceat(shared, head), size)
        return np.bincount(section, part, len(start)), crossing
    if rule == "majority":
        most = np.repeat(np.maximum.reduceat(shared, head), size)
        head = np.minimum.reduceat(np.where(shared == most, np.arange(len(token)), len(token)), head)
    return np.bincount(section[head], minlength=len(start)).astype(float), crossing


def count_tokens(df: DataFrame, sections: str | None = None, column: str = "text", rule: str = "majority", file: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each section: ``keep``, section, start, stop, n_tokens, n_crossing, text_tokens.

    ``sections`` names an ``array<struct<section:int,start:int,stop:int>>`` column in
    characters; without it every line, with its line feed, is a section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    chosen = df.select(*keep, text_or_empty(column).alias("_count_text"), *([F.col(sections).alias("_spans")] if sections else []))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)

    def spans_of(batch: pa.RecordBatch, i: int, text: str) -> np.ndarray:
        if sections:
            found = [(s["section"], s["start"], s["stop"]) for s in batch.column("_spans")[i].as_py() or [] if s and None not in s.values()]
        else:
            size = np.array([len(x) + 1 for x in text.split("\n")])
            stop = np.minimum(np.cumsum(size), len(text))
            start = np.append(0, stop[:-1])
            some = stop > start
            return np.stack([np.arange(int(some.sum())), start[some], stop[some]], 1)
        return np.array(sorted(found, key=lambda x: x[1:]), np.int64).reshape(-1, 3)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(file)
        for whole in batches:
            for batch in slices(whole, "_count_text", 1 << 20):
                parts, rows, counts = [], [], []
                for i, text in enumerate(batch.column("_count_text").to_pylist()):
                    spans = spans_of(batch, i, text)
                    ids = bpe.encode(text)
                    n, crossing = attribute(*bpe.spans(ids), spans[:, 1], spans[:, 2], rule)
                    parts.append(np.column_stack([spans, crossing, np.full(len(spans), len(ids))]))
                    rows.append(np.full(len(spans), i))
                    counts.append(n)
                made = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
                of = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
                columns = [batch.column(c).take(of) for c in keep]
                columns += [pa.array(made[:, k].astype(np.int64)) for k in (0, 1, 2)]
                columns += [pa.array(np.concatenate(counts) if counts else np.zeros(0))] + [pa.array(made[:, k].astype(np.int64)) for k in (3, 4)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "section", "start", "stop", "n_tokens", "n_crossing", "text_tokens"])

    return in_arrow(chosen, work, f"{schema}, section long, start long, stop long, n_tokens double, n_crossing long, text_tokens long")
