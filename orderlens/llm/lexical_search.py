"""Ranked lexical search: the exact best documents of each item, by sparse ball trees.

A document is a vector over terms: the weight of the term times a saturating share of its
occurrences, an integer. An item is a vector of ones at its terms, so a score is an inner product.
Only terms of some item can count; a bit table of fixed size (with a few false hits) drops the
others while the documents are read, which changes no inner product.

The vectors are dealt at random into blocks of about ``POSTINGS`` terms, the items into slices
of about ``TERMS`` terms, and each block meets each slice in one group of a co-group: the
stated items against all documents, in blocks. In a group a ball tree is built over the block: a ball
is halved between two far points until it holds ``LEAF`` documents or one point. No document of a
ball with centre c and radius r scores more than q.c + |q| r, where |q| counts the item's
terms in the ball. The radius is rounded up by a bound of its rounding error, and so is the sum.
An item searches the tree best-first and stops at the first ball that can't reach
its k-th score; documents of the leaves it reaches are scored in 64-bit integers.

One block in ``AHEAD`` is searched first; the k-th best score found there is a floor for all other
blocks, so most of them give back few rows. The k best of the items' rows are taken by a
window that Spark cuts to k rows in each task before its shuffle.

Defined cases: null and empty texts have no terms; items without terms have no rows; an item is a
distinct pair of item_id and text, so repeated rows count once; a document counts as often as it
is there; equal scores are ranked by doc_id, nulls last, and equal rows in any order. Texts
of any length are read whole; extra columns are ignored; empty tables give no rows. Terms are
compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow
from orderlens.llm.textbytes import mix, per_text_unique, plain_words, slices
from orderlens.session import stage

#: Terms of documents in a block and of items in a slice.
POSTINGS, TERMS = 1_000_000, 50_000
LEAF = 48
AHEAD = 16
#: Bits of the table of the items' terms (1 MB).
BITS = 23
#: Length of documents counts for 90 %, occurrences saturate at about 0.8 of an average one.
LENGTH, SATURATION = 90, 8
_NO_ID = np.iinfo(np.int64).max


def _counted_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All terms of each text (number), and its distinct ones (hash, occurrences, offsets)."""
    hashes, at = plain_words(column)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    unique, bounds = per_text_unique(hashes, at)
    if not len(unique):
        return np.diff(at), unique.view(np.int64), np.zeros(0, np.int32), bounds
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]))))
    return np.diff(at), unique.view(np.int64), np.diff(np.append(first, len(h))).astype(np.int32), bounds


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, key (of the text) and the distinct terms of each distinct item that has some."""
    chosen = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    chosen = chosen.select("item_id", F.xxhash64("text").alias("key"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                _, terms, _, at = _counted_terms(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(terms))
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("key"), lists], ["item_id", "key", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    return in_arrow(chosen, work, f"item_id {kind}, key long, terms array<long>").where(F.size("terms") > 0)


def _bit_table(items: DataFrame) -> np.ndarray:
    """A table of 2 ** BITS bits with those of all items' terms set: bounded however many there are."""
    words = items.select(F.explode("terms").alias("h")).select(F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)).alias("s"))
    words = words.groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 AS int)))").alias("bits"))
    table = np.zeros(1 << (BITS - 5), np.uint32)
    for w, bits in words.collect():  # one row for each word of the table at most
        table[w] = bits
    return table


def _vectors(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, number of terms, a number to deal by, and those distinct terms that may be an item's, of documents with terms."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                n, terms, times, at = _counted_terms(batch.column("text"))
                slot = terms & ((1 << BITS) - 1)
                keep = (table[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1
                at = np.concatenate(([0], np.cumsum(keep)))[at]
                number = np.arange(row, row + len(n), dtype=np.uint64) + np.uint64(part << 40)
                row += len(n)
                columns = [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array((mix(number) >> np.uint64(1)).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(terms[keep])),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(times[keep])),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "deal", "terms", "times"]).filter(pa.array(n > 0))

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_arrow(chosen, work, "doc_id long, n long, deal long, terms array<long>, times array<int>")


class BallTree:
    """Balls over sparse rows (offsets, columns, positive integer values), each row in one leaf.

    ``order`` lists the rows leaf by leaf; a ball has the rows order[low:high].
    """

    def __init__(self, at: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.order = np.arange(len(at) - 1)
        self.width = width
        self.low, self.high, self.radius, self.kids = [], [], [], []
        self.support: list[np.ndarray] = []  # columns of the centre, and its values
        self.centre: list[np.ndarray] = []
        size = np.diff(at)
        stack = [(0, len(size), self.order, size, columns, values.astype(np.float64), -1)]
        while stack:
            low, high, rows, size, cols, x, parent = stack.pop()
            here = len(self.low)
            if parent >= 0:
                self.kids[parent].append(here)
            far = self._ball(low, high, size, cols, x)
            if len(rows) <= LEAF or self.radius[here] <= self.point:
                self.order[low:high] = rows
                continue
            right = self._halves(far, size, cols, x)
            cut = np.repeat(right, size)
            middle = low + int((~right).sum())
            stack.append((low, middle, rows[~right], size[~right], cols[~cut], x[~cut], here))
            stack.append((middle, high, rows[right], size[right], cols[cut], x[cut], here))
        # the postings in the order of the leaves
        size = np.diff(at)[self.order]
        self.at = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(int(self.at[-1])) + np.repeat(at[:-1][self.order] - self.at[:-1], size)
        self.columns, self.values = columns[take], values[take]

    def _ball(self, low: int, high: int, size: np.ndarray, cols: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Note a ball; gives the rows' squared distances from its centre."""
        total = np.bincount(cols, x, self.width) / len(size)
        support = np.flatnonzero(total)
        first = np.cumsum(size) - size
        square = np.add.reduceat(x * x, first)
        centre = float(total @ total)
        distance = square - 2 * np.add.reduceat(x * total[cols], first) + centre
        # a bound of what rounding can have taken off the squares: (terms) * 2 ** -52 of the sum's parts, twice over
        error = (len(support) + 16) * 2.0**-50 * (float(square.max()) + centre)
        self.point = 2 * math.sqrt(error)  # no more than rounding: all rows are one point
        self.radius.append(math.sqrt(max(float(distance.max()), 0.0) + error) * (1 + 2.0**-40))
        self.low.append(low)
        self.high.append(high)
        self.kids.append([])
        self.support.append(support)
        self.centre.append(total[support])
        return distance

    def _halves(self, distance: np.ndarray, size: np.ndarray, cols: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Which rows are nearer to the second of two far points."""
        end = np.cumsum(size)
        first = end - size
        square = np.add.reduceat(x * x, first)

        def from_row(r: int) -> np.ndarray:
            point = np.zeros(self.width)
            point[cols[first[r] : end[r]]] = x[first[r] : end[r]]
            return square - 2 * np.add.reduceat(x * point[cols], first) + square[r]

        a = from_row(int(distance.argmax()))
        right = a > from_row(int(a.argmax()))
        if right.all() or not right.any():
            right = np.arange(len(size)) % 2 == 1
        return right

    def best(self, item: np.ndarray, ids: np.ndarray, k: int, floor: int) -> tuple[list[tuple[int, int]], int]:
        """(-score, id) of the item's k best rows that score at least ``floor`` (and more than 0), and the number of rows scored."""
        q = np.zeros(self.width, np.int64)
        q[item] = 1
        found: list[tuple[int, int]] = []  # heap of the k best, worst first: (score, -id)
        least, scored = max(floor, 1), 0
        heap = [(-self._bound(0, q), 0)]
        while heap:
            bound, ball = heapq.heappop(heap)
            if -bound < least:
                break
            if self.kids[ball]:
                for kid in self.kids[ball]:
                    if (reach := self._bound(kid, q)) >= least:
                        heapq.heappush(heap, (-reach, kid))
                continue
            low, high = self.low[ball], self.high[ball]
            a, b = self.at[low], self.at[high]
            scores = np.add.reduceat(self.values[a:b] * q[self.columns[a:b]], self.at[low:high] - a)
            scored += high - low
            for r in np.flatnonzero(scores >= least).tolist():
                entry = (int(scores[r]), -int(ids[self.order[low + r]]))
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
            if len(found) == k:
                least = max(least, found[0][0])
        return [(-s, -i) for s, i in found], scored

    def _bound(self, ball: int, q: np.ndarray) -> float:
        """What no row of the ball exceeds, rounded up."""
        there = q[self.support[ball]]
        return (float(there @ self.centre[ball]) + math.sqrt(int(there.sum())) * self.radius[ball]) * (1 + 2.0**-30) + 1.0


def _weights(share: np.ndarray, documents: int) -> np.ndarray:
    """Weight of each term from the number of documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in share.tolist()], np.int64)


def _search_block(docs: pa.Table, items: pa.Table, k: int, documents: int, total: int) -> Iterator[tuple]:
    """(row of the item, score, document) of the k best of a block, for each item of a slice."""
    lists = items.column("terms").combine_chunks()
    item_at = lists.offsets.to_numpy().astype(np.int64)
    item_at -= item_at[0]
    wanted = lists.flatten().to_numpy()
    share = items.column("share").combine_chunks().flatten().to_numpy()
    known, first = np.unique(wanted, return_index=True)
    weight = _weights(share[first], documents)
    own = docs.column("terms").combine_chunks()
    size = np.diff(own.offsets.to_numpy().astype(np.int64))
    term, times = own.flatten().to_numpy(), docs.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    column = np.searchsorted(known, term)
    hit = known[np.minimum(column, len(known) - 1)] == term
    hit &= np.where(hit, weight[np.minimum(column, len(known) - 1)], 0) > 0
    row = np.repeat(np.arange(len(size)), size)[hit]
    kept = np.bincount(row, minlength=len(size))
    some = np.flatnonzero(kept)
    if not len(some):
        return
    spread = 100 - LENGTH + LENGTH * docs.column("n").to_numpy() * documents // total
    column, times = column[hit], times[hit]
    value = weight[column] * (1_000_000_000 * times // (1000 * times + SATURATION * spread[row]))
    at = np.concatenate(([0], np.cumsum(kept[some])))
    ids = docs.column("doc_id").combine_chunks().fill_null(_NO_ID).to_numpy()[some]
    tree = BallTree(at, column, value, len(known))
    place = np.searchsorted(known, wanted)
    floors = items.column("floor").to_pylist()
    for i, floor in enumerate(floors):
        best, _ = tree.best(place[item_at[i] : item_at[i + 1]], ids, k, floor)
        for score, doc in best:
            yield i, -score, None if doc == _NO_ID else doc


def _in_blocks(vectors: DataFrame, items: DataFrame, blocks: int, parts: int, ahead: bool, k: int, documents: int, total: int) -> DataFrame:
    """The k best rows of each item in each block of one kind: those searched ahead, or the others."""
    kind = (F.col("block") % AHEAD == 0) == F.lit(ahead)
    left = vectors.where(kind).select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slice"), "doc_id", "n", "terms", "times")
    first = F.col("first")
    right = items.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1), F.lit(1024))))
    right = right.withColumn("block", F.explode(F.sequence(first, F.least(first + 1023, F.lit(blocks - 1))))).where(kind)
    right = right.select("block", "slice", "item_id", "key", "terms", "share", "floor")

    def work(docs: pa.Table, items: pa.Table) -> pa.Table:
        found = list(_search_block(docs, items, k, documents, total)) if docs.num_rows and items.num_rows else []
        rows, scores, ids = zip(*found, strict=True) if found else ((), (), ())
        which = items.select(["item_id", "key"]).take(pa.array(rows, pa.int64()))
        return which.append_column("score", pa.array(scores, pa.int64())).append_column("doc_id", pa.array(ids, pa.int64()))

    groups = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice"))
    return groups.applyInArrow(work, f"item_id {items.schema['item_id'].dataType.simpleString()}, key long, score long, doc_id long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item.

    ``docs`` has doc_id (an integer) and text, ``items`` item_id and text.
    """
    result = "item_id", "rank", "doc_id", "score"
    asked = stage(_item_terms(items), "items")
    vectors = stage(_vectors(docs, _bit_table(asked)), "vectors")
    documents, total, postings = (x or 0 for x in vectors.agg(F.count("*"), F.sum("n"), F.sum(F.size("terms"))).first())
    blocks = max(1, math.ceil(postings / POSTINGS))
    parts = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / TERMS))
    share = vectors.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count("*").alias("share"))
    asked = asked.select("item_id", "key", F.explode("terms").alias("h")).join(share, "h")
    asked = asked.groupBy("item_id", "key").agg(F.collect_list(F.struct("h", "share")).alias("each"))
    slice_of = F.pmod(F.xxhash64("item_id", "key"), F.lit(parts)).cast("int")
    asked = asked.select("item_id", "key", F.col("each.h").alias("terms"), F.col("each.share").alias("share"), slice_of.alias("slice"))
    asked = stage(asked.withColumn("floor", F.lit(0).cast("long")), "weighted-items")
    vectors = vectors.where(F.size("terms") > 0).withColumn("block", F.pmod("deal", F.lit(blocks)).cast("int"))
    found = stage(_in_blocks(vectors, asked, blocks, parts, True, k, documents, total), "found-ahead")
    if blocks > 1:
        floors = _top(found, k).groupBy(F.col("item_id").alias("_item"), F.col("key").alias("_key"))
        floors = floors.agg(F.when(F.count("*") == k, F.min("score")).alias("reached"))
        asked = asked.join(floors, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("key") == F.col("_key")), "left")
        asked = asked.withColumn("floor", F.coalesce("reached", "floor")).drop("_item", "_key", "reached")
        found = found.unionByName(_in_blocks(vectors, asked, blocks, parts, False, k, documents, total))
    return _top(found, k).select(*result)
