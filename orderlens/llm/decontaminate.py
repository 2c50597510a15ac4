"""Benchmark decontamination: latent semantic retrieval, then an exact check.

Words (lower case, no punctuation) are hashed to ``BUCKETS`` features, weighted by TF-IDF with
document frequencies of all documents. A randomised SVD (power iterations whose sums come
from Spark tasks) over the passages of all documents and the items, equal texts once, gives
``RANK`` directions; passages and items are compared by the cosine of their whitened coordinates. Every document
is cut into blocks of ``BLOCK`` words; an item of n words is compared with every run of
ceil(n / BLOCK) + 1 blocks, so any occurrence lies whole in a run. Runs near enough
(``COSINE``) are candidates, and so are runs that share ``SAME`` of the item's words. A candidate is verified word by word around the run: the longest
common subsequence must hold ``SAME`` of the item's words, or ``LOOSE`` of them if also the item's
answer, its last sentence, stands there word for word. An answer of less than ``PLAIN`` words may
stand anywhere by chance, so it must come at most ``BEHIND`` words after words in common, which
with it must be ``LOOSE`` of the item's. An item of one sentence has no answer. It is looked for only where the words that
the item and the run share, which bound it from above, are that many.

Items of less than ``SHORTEST`` words say too little for a cosine or a share: all their words must
stand next to each other in a document.

Items go to every task in groups of about ``ITEMS`` items and ``CHARACTERS`` characters (a bound on
what is broadcast, but for a single longer item); more items are more passes. Documents are never
shuffled; the features of their words (two bytes a word) are, once, to find equal texts.

Defined cases: null and empty texts are clean; an item without words matches nothing; repeated
documents are judged each, benchmark rows with equal id and text count as one item; of equally
good runs the first counts; very long texts are searched whole; null ids are kept; other columns
may have any name; an empty benchmark or table gives no leaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructType

from orderlens.llm.common import apart, bounded_batches, in_arrow, text_or_empty
from orderlens.llm.textbytes import PUNCTUATION, mix, places, plain_words, slices, slots, word_spans
from orderlens.session import stage

BUCKETS, RANK, EXTRA, POWER = 1 << 14, 64, 16, 2
#: A word that an item repeats this often or more counts wherever it stands in a run.
OFTEN = 8
BLOCK = 8
#: Words of a passage, passages that are multiplied together, and occurrences in these that make a feature frequent.
PASSAGE, TOGETHER, FREQUENT = 48, 512, 24
#: Share of the cosine of an unchanged copy, among as many other words as its run holds, that makes a candidate.
COSINE = 0.55
SAME, LOOSE = 0.8, 0.6
#: Words of an answer that needs no place, and words before a shorter one of which one must be in common.
PLAIN, BEHIND = 3, 4
SHORTEST, ITEMS, CHARACTERS = 5, 2_000, 1_000_000
#: Rows of the feature matrix that travel as one row of a frame.
CHUNK = 1 << 9


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(50)).astype(np.int64)


def featured(texts: DataFrame) -> DataFrame:
    """features (of all words, two bytes each) and n of every different text among the rows (text, n), n summed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                hashes, bounds = plain_words(batch.column("text"))
                bucket = buckets(hashes).astype(np.uint16)
                each = pa.array([bucket[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("one", "two", "n")), each], ["one", "two", "n", "features"])

    keyed = texts.select(F.xxhash64("text").alias("one"), F.xxhash64(F.lit(1), "text").alias("two"), F.col("n").cast("long").alias("n"), "text")
    return in_arrow(keyed, work, "one long, two long, n long, features binary").groupBy("one", "two", "features").agg(F.sum("n").alias("n")).select("features", "n")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The features of all texts, and the texts' bounds among them."""
    each = column.to_pylist()
    return np.frombuffer(b"".join(each), np.uint16).astype(np.int64), np.cumsum([0, *(len(x) // 2 for x in each)])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and all documents, from the rows of ``featured``.

    At most ``BUCKETS`` + 1 rows come to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            bucket, bounds = unpacked(batch.column("features"))
            n = batch.column("n").to_numpy()
            seen = np.zeros(batch.num_rows * BUCKETS, bool)
            seen[np.repeat(np.arange(batch.num_rows) * BUCKETS, np.diff(bounds)) + bucket] = True
            held = np.flatnonzero(seen)
            np.add.at(total, held % BUCKETS, n[held // BUCKETS])
            rows += int(n.sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], rows))], ["bucket", "n"])

    out, n = np.zeros(BUCKETS, np.int64), 0
    for row in in_arrow(texts, work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if row.bucket == -1:
            n = row.n
        else:
            out[row.bucket] = row.n
    return out, n


def passages(bucket: np.ndarray, bounds: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage of every word, in passages of PASSAGE words, a shorter rest included, and one over each passage's length."""
    count = -(-np.diff(bounds) // PASSAGE)
    inner = np.arange(len(bucket)) - np.repeat(bounds[:-1], np.diff(bounds))
    passage = np.repeat(np.cumsum(count) - count, np.diff(bounds)) + inner // PASSAGE
    return passage, 1 / np.sqrt(np.maximum(np.bincount(passage, (idf.astype(np.float64) ** 2)[bucket]), 1e-12)).astype(np.float32)


def add_rows(total: np.ndarray, row: np.ndarray, source: np.ndarray, at: np.ndarray) -> None:
    """``np.add.at(total, row, source[at])`` for sorted ``row``, an occurrence of all rows at a time."""
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(head, len(row)))
    order = np.argsort(-size, kind="stable")
    head, size, row = head[order], size[order], row[head[order]]
    part = np.take(source, at[head], 0)
    more = np.empty_like(part)
    upto = np.searchsorted(-size, -np.arange(1, int(size[0]))).tolist()  # those that occur more than j times
    for j, n in enumerate(upto, 1):
        part[:n] += np.take(source, at[head[:n] + j], 0, more[:n], "clip")
    total[row] += part


def add_products(total: np.ndarray, scaled: np.ndarray, bucket: np.ndarray, passage: np.ndarray, weight: np.ndarray, gram: bool) -> None:
    """Add (A B)^T (A B) if ``gram``, else A^T (A B), of these passages, with A a word's number in a passage by
    ``weight`` and B ``scaled``."""
    local = np.empty(BUCKETS, np.int64)
    cuts = np.searchsorted(passage, np.arange(0, int(passage[-1]) + 1 + TOGETHER, TOGETHER)).tolist()
    for first, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        own, place = bucket[low:high], passage[low:high] - first * TOGETHER
        each = weight[first * TOGETHER : (first + 1) * TOGETHER, None]
        times = np.bincount(own, minlength=BUCKETS)
        # frequent features make a small dense matrix, the others are added one by one
        active = np.flatnonzero(times >= FREQUENT)
        local[active] = np.arange(len(active))
        often = times[own] >= FREQUENT
        dense = np.bincount(place[often] * len(active) + local[own[often]], minlength=len(each) * len(active)).astype(np.float32).reshape(len(each), len(active))
        shown = dense @ scaled[active]
        seldom = np.flatnonzero(~often)
        own, place = own[seldom], place[seldom]
        if len(own):
            add_rows(shown, place, scaled, own)
        shown *= each
        if gram:
            total += shown.T @ shown
            continue
        shown *= each
        total[active] += dense.T @ shown
        if len(own):
            order = np.argsort(own.astype(np.int16), kind="stable")  # a radix sort; features are below 2**15
            add_rows(total, own[order], shown, place[order])


def _summed(texts: DataFrame, idf: np.ndarray, basis: np.ndarray, gram: bool) -> np.ndarray:
    """Sum over the tasks of (A B)^T (A B) if ``gram``, else of A^T (A B), for the passages A of all texts and ``basis`` B."""
    given = texts.sparkSession.sparkContext.broadcast((idf, basis))
    height, width = (basis.shape[1], basis.shape[1]) if gram else basis.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis = given.value
        scaled = basis * idf[:, None]
        total = np.zeros((height, width), np.float32)
        for batch in batches:
            bucket, bounds = unpacked(batch.column("features"))
            if len(bucket):
                add_products(total, scaled, bucket, *passages(bucket, bounds, idf), gram)
        if not gram:
            total *= idf[:, None]
        parts = [total[k : k + CHUNK].tobytes() for k in range(0, height, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(part, np.float32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "part"])

    schema = "chunk int, part binary"
    rows = in_arrow(texts.select("features"), work, schema).repartition("chunk").mapInArrow(add, schema).collect()
    given.unpersist()
    parts = {r.chunk: np.frombuffer(r.part, np.float32) for r in rows}
    return np.concatenate([parts[k] for k in sorted(parts)]).reshape(height, width) if parts else np.zeros((height, width), np.float32)


def directions(texts: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Features by RANK: right singular vectors of all passages, each over its singular value."""
    basis = np.random.default_rng(17).standard_normal((BUCKETS, RANK + EXTRA)).astype(np.float32)
    for _ in range(POWER + 1):
        basis = np.linalg.qr(_summed(texts, idf, basis, False))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(_summed(texts, idf, basis, True).astype(np.float64))
    best = np.argsort(values)[::-1][:RANK]
    scale = np.sqrt(np.maximum(values[best], 1e-9))
    return ((basis @ vectors[:, best]) / scale).astype(np.float32)


def lcs_length(one: list, two: list) -> int:
    """Longest common subsequence, a bit for each word of ``one``."""
    places: dict = {}
    for i, w in enumerate(one):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(one)) - 1
    row = full
    for w in two:
        met = places.get(w, 0) & row
        if met:
            row = ((row + met) | (row - met)) & full
    return len(one) - row.bit_count()


def answer_words(text: str) -> int:
    """How many words the last sentence of ``text`` has."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, _ = word_spans(data, np.array([0, len(data)]), PUNCTUATION)
    ends = np.flatnonzero(np.isin(data, np.frombuffer(b".!?:\n", np.uint8)))
    ends = ends[ends < (starts[-1] if len(starts) else 0)]
    return int((starts > ends[-1]).sum()) if len(ends) else 0


def follows(own: list, n: int, here: list) -> bool:
    """Whether the last ``n`` words of an item stand in ``here`` right behind words in common with the item's others."""
    body, answer = own[:-n], own[-n:]
    for p in range(1, len(here) - n + 1):
        if here[p : p + n] == answer:
            common = lcs_length(body, here[:p])
            if common + n >= LOOSE * len(own) and common > lcs_length(body, here[: max(p - BEHIND, 0)]):
                return True
    return False


def neighbours(hashes: np.ndarray, n: int) -> np.ndarray:
    """A code of every ``n`` words in a row, by their first one."""
    size = max(len(hashes) - n + 1, 0)
    code = hashes[:size]
    for j in range(1, n):
        code = mix(code) + hashes[j : size + j]
    return code


def sums_from(rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``size`` rows one below the other, by the first of them, from sums of powers of two rows."""
    n, at, width, out = len(rows) - size + 1, 0, 1, None
    while True:
        if size & width:
            out = rows[at : at + n] if out is None else out + rows[at : at + n]
            at += width
        if at == size:
            return out
        rows = rows[:-width] + rows[width:]
        width *= 2


def reached(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places in the flat ``rows`` that are at least ``least`` of their column, many rows compared in one stroke."""
    many = 64
    even = len(rows) // many * many
    found = np.flatnonzero(rows[:even].reshape(-1, many * len(least)) >= np.tile(least, many))
    return np.append(found, np.flatnonzero(rows[even:] >= least) + even * len(least))


class Searcher:
    """The items of one group, with their coordinates."""

    def __init__(self, ids: list, texts: list[str], idf: np.ndarray, space: np.ndarray):
        hashes, bounds = plain_words(pa.array(texts, pa.string()))
        long = np.flatnonzero(np.diff(bounds) >= SHORTEST)
        self.ids = [ids[i] for i in long]
        self.words = [hashes[bounds[i] : bounds[i + 1]].tolist() for i in long]
        self.answers = [answer_words(texts[i]) for i in long]
        # the last row is that of no word, here and in times
        self.weighted = np.append(space * idf[:, None].astype(np.float32), np.zeros((1, space.shape[1]), np.float32), 0)
        # the sum of a run's rows is its place, up to a factor that the cosine doesn't see
        place = np.array([self.weighted[buckets(np.array(w, np.uint64))].sum(0) for w in self.words], np.float32).reshape(-1, RANK)
        self.place = place / np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-12)
        # how often each word of any item stands in every item
        self.known = np.unique(np.array([w for own in self.words for w in own], np.uint64))
        self.slot = slots(self.known)
        self.times = np.zeros((len(self.known) + 1, len(self.words)), np.uint8)
        for k, w in enumerate(self.words):
            own, n = np.unique(np.array(w, np.uint64), return_counts=True)
            self.times[np.searchsorted(self.known, own), k] = np.minimum(n, OFTEN)
        self.least = np.array([(LOOSE if self.asked(k) else SAME) * len(w) for k, w in enumerate(self.words)])
        self.runs: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            self.runs.setdefault(-(-len(w) // BLOCK) + 1, []).append(k)
        # shorter items come behind the others: by number of words, the codes of their words and the items of each code
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHORTEST)).tolist():
            own = hashes[bounds[i] : bounds[i + 1]]
            self.short.setdefault(len(own), {}).setdefault(int(neighbours(own, len(own))[0]), []).append(len(self.words))
            self.ids.append(ids[i])
            self.words.append(own.tolist())
            self.answers.append(0)

    def asked(self, k: int) -> bool:
        """Whether an item's answer can make up for changed words."""
        return 1 <= self.answers[k] < len(self.words[k])

    def answered(self, hashes: np.ndarray, occurs: dict[int, np.ndarray]) -> np.ndarray:
        """Sorted places of all items' answers: item * (words + 1) + first word."""
        out = [np.zeros(0, np.int64)]
        for k, own in enumerate(self.words):
            if not self.asked(k):
                continue
            answer = own[-self.answers[k] :]
            at = occurs.get(answer[0], out[0])
            at = at[at + len(answer) <= len(hashes)]
            for j, w in enumerate(answer[1:], 1):
                if not len(at):
                    break
                at = at[hashes[at + j] == np.uint64(w)]
            out.append(at + k * (len(hashes) + 1))
        return np.concatenate(out)

    def shared(self, word: np.ndarray, low: np.ndarray, high: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Words that each item has in common with the words from ``low`` to ``high``, as often as both have them."""
        out = np.zeros(len(low), np.int64)
        width = int((high - low).max(initial=1))
        step = max(1, (1 << 18) // width)
        asked = np.zeros(len(word), bool)
        for i in range(0, len(low), step):
            asked[np.minimum(low[i : i + step, None] + np.arange(width), len(word) - 1)] = True
        # where equal words stand before those asked for
        some = np.flatnonzero(asked & (word < len(self.known)))
        order = np.argsort(word[some].astype(np.int16 if len(self.known) < 1 << 15 else np.int32), kind="stable")
        before, number = np.full((OFTEN + 1, len(some) + 1), -1, np.int32), np.full(len(word), len(some), np.int32)
        before[0], number[some] = np.iinfo(np.int32).max, np.arange(len(some))
        for k in range(1, OFTEN):
            same = word[some[order[k:]]] == word[some[order[:-k]]]
            before[k, order[k:][same]] = some[order[:-k][same]]
        for i in range(0, len(low), step):
            first, k = low[i : i + step, None], items[i : i + step, None]
            at = first + np.arange(width)
            inside = at < high[i : i + step, None]
            at = np.minimum(at, len(word) - 1)
            # a word counts if as many equal ones as the item has don't stand before it in the run
            out[i : i + step] = ((before[self.times[word[at], k], number[at]] < first) & inside).sum(1)
        return out

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, float, bool, float]]:
        """(text, item, first word of the run with its margins and the one after, words needed, answered, cosine), best first in each text and item."""
        n = np.diff(bounds)
        count = -(-n // BLOCK)
        text = np.repeat(np.arange(len(n)), count)
        if not len(text) or not self.runs:
            return
        inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = bounds[text] + inner * BLOCK
        last = np.cumsum(count)[text]
        blocks = len(text)
        # the words as rows of times
        word = np.minimum(places(self.known, self.slot, hashes), len(self.known) - 1)
        word = np.where(self.known[word] == hashes, word, len(self.known)).astype(np.int32)
        some = np.flatnonzero(word < len(self.known))
        order = some[np.argsort(word[some].astype(np.int16 if len(self.known) < 1 << 15 else np.int32), kind="stable")]
        cut = np.append(np.flatnonzero(np.append(True, word[order][1:] != word[order][:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
        occurs = {int(hashes[order[a]]): order[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)}
        answers = self.answered(hashes, occurs)
        # how many words of each item stand in a block, a word of each block at a time
        place = np.arange(len(hashes)) - np.repeat(bounds[:-1], n) + np.repeat((np.cumsum(count) - count) * BLOCK, n)
        cells, feature = np.full(blocks * BLOCK, len(self.known), np.int32), np.full((blocks + 1) * BLOCK, BUCKETS, np.int32)
        cells[place], feature[place] = word, buckets(hashes)
        cells, feature = cells.reshape(-1, BLOCK).T, feature.reshape(-1, BLOCK)
        met = (self.times[:, np.concatenate([*self.runs.values()])] > 0).astype(np.uint8)
        held, more = met[cells[0]], np.empty((blocks, met.shape[1]), np.uint8)
        for j in range(1, BLOCK):
            held += np.take(met, cells[j], 0, more, "clip")
        # sums of blocks where a run may be a candidate, and of no words
        sums, done = np.zeros((blocks + 1, self.weighted.shape[1]), np.float32), np.zeros(blocks + 1, bool)
        column = 0
        for length, group in self.runs.items():
            items, column = np.array(group), column + len(group)
            # runs that end where the text does, with fewer blocks, are parts of longer ones except the first
            use = (inner == 0) | (inner + length <= count[text])
            least = np.array([COSINE * np.sqrt(len(self.words[k]) / (length * BLOCK)) for k in group], np.float32)
            # the run with a block on each side, here of the next text too, must hold as many of the item's words, whatever their order
            most = (length + 2) * BLOCK
            kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
            enough, plenty = np.ceil(self.least[items]).astype(kind), np.ceil(SAME * np.array([len(self.words[k]) for k in group]))
            padded = np.zeros((blocks + length + 2, len(items)), kind)
            padded[1 : blocks + 1] = held[:, column - len(items) : column]
            there = sums_from(padded, length + 2)[:blocks]
            row, k = np.divmod(reached(there, enough), len(items))
            row, k = row[use[row]], k[use[row]]
            if len(row):
                run, own_run = np.unique(row, return_inverse=True)
                members = run[:, None] + np.arange(length)
                members = np.where(members < last[run][:, None], members, blocks)
                new = np.zeros(blocks + 1, bool)
                new[members] = True
                new = np.flatnonzero(new & ~done)
                sums[new] = self.weighted[feature[new, 0]]
                for j in range(1, BLOCK):
                    sums[new] += self.weighted[feature[new, j]]
                done[new] = True
                own = np.zeros((len(run), sums.shape[1]))
                for j in range(length):
                    own += sums[members[:, j]]
                own = own.astype(np.float32)
                own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
                cosine, have = (own @ self.place[items].T)[own_run, k], there[row, k]
                some = np.flatnonzero((have >= plenty[k]) | (cosine >= least[k]))
                row, k, cosine, have = row[some], k[some], cosine[some], have[some]
                left = row - (inner[row] > 0)
                low, high = start[left], np.minimum(start[row] + (length + 1) * BLOCK, bounds[text[row] + 1])
                item = items[k]
                size = np.array([len(self.words[i]) for i in item.tolist()], np.int64)
                there = np.zeros(len(item), bool)
                if len(answers):
                    base = item * (len(hashes) + 1)
                    ends = base + high - np.array(self.answers)[item]
                    next_ = np.searchsorted(answers, base + low)
                    there = (next_ < len(answers)) & (answers[np.minimum(next_, len(answers) - 1)] <= ends)
                need = np.where(there & (cosine >= least[k]), LOOSE, SAME) * size
                good = np.flatnonzero(have >= need)
                good = good[self.shared(word, low[good], high[good], item[good]) >= need[good]]
                for i in good[np.argsort(-cosine[good], kind="stable")].tolist():
                    yield int(text[row[i]]), int(item[i]), int(low[i]), int(high[i]), float(need[i]), bool(there[i]), float(cosine[i])

    def whole(self, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, tuple[int, bool, float]]]:
        """Like ``leaks``, the items of less than ``SHORTEST`` words: all of them next to each other."""
        found: dict[int, dict[int, tuple[int, bool, float]]] = {}
        for n, items in self.short.items():
            codes = np.array(sorted(items), np.uint64)
            code = neighbours(hashes, n)
            i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            at = np.flatnonzero(codes[i] == code)
            text = np.searchsorted(bounds, at, "right") - 1
            inside = at + n <= bounds[text + 1]
            for t, c in np.unique(np.stack([text[inside], i[at][inside]]), axis=1).T.tolist():
                for k in items[int(codes[c])]:
                    found.setdefault(t, {})[k] = (n, False, 1.0)
        return found

    def leaks(self, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, tuple[int, bool, float]]]:
        """For each text its items: common words, whether the answer is there, cosine."""
        found = self.whole(hashes, bounds)
        for text, item, low, high, need, answered, cosine in self.candidates(hashes, bounds):
            if item in found.get(text, ()):
                continue
            own = self.words[item]
            here = hashes[low:high].tolist()
            common = lcs_length(own, here)
            if common >= need and answered and self.answers[item] < PLAIN:
                answered = follows(own, self.answers[item], here)
            if common >= (need if answered else SAME * len(own)):
                found.setdefault(text, {})[item] = (common, answered, cosine)
        return found


LEAK = StructType().add("item_id", LongType()).add("common_words", LongType()).add("item_words", LongType()).add("answered", BooleanType()).add("cosine", DoubleType())
LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("common_words", pa.int64()), ("item_words", pa.int64()), ("answered", pa.bool_()), ("cosine", pa.float64())]))


def marked(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """All rows and columns, and ``_leaks``: the items that each document holds."""
    spark = docs.sparkSession
    texts = docs.select(text_or_empty(column).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty("text").alias("text")).distinct()
    asked, characters = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    # items shape the directions, but are no documents
    known = stage(featured(texts.withColumn("n", F.lit(1)).unionByName(items.select("text", F.lit(0).alias("n")))), "features")
    df, n = document_frequencies(known)
    idf = np.log((n + 1) / (df + 0.5)).clip(0.1).astype(np.float32)
    space = directions(known, idf)
    groups = max(1, -(-asked // ITEMS), -(-characters // CHARACTERS))
    out, schema = docs, StructType([*docs.schema.fields]).add("_leaks", ArrayType(LEAK))
    names = docs.columns
    bounded_batches(spark)
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        given = spark.sparkContext.broadcast(Searcher([r.item_id for r in rows], [r.text for r in rows], idf, space))

        def work(batches: Iterator[pa.RecordBatch], given=given, first=g == 0) -> Iterator[pa.RecordBatch]:
            searcher = given.value
            for whole in batches:
                for batch in slices(whole, column, 1 << 20):
                    found = searcher.leaks(*plain_words(batch.column(column)))
                    told = [[]] * batch.num_rows if first else batch.column("_leaks").to_pylist()
                    for i, own in found.items():
                        told[i] = [*told[i], *({"item_id": searcher.ids[k], "common_words": c, "item_words": len(searcher.words[k]), "answered": a, "cosine": x} for k, (c, a, x) in sorted(own.items()))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(told, LEAKS)], [*names, "_leaks"])

        out = out.mapInArrow(work, schema)
    return out


def leaked(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and item of every benchmark passage found in a document."""
    return marked(docs.select("doc_id", column), benchmark, column).select("doc_id", F.explode("_leaks").alias("l")).select("doc_id", "l.*")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    given = apart(docs, column)
    return marked(given, benchmark, column).where(F.size("_leaks") == 0).select(*given.columns).toDF(*docs.columns)
