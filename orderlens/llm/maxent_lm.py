"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The ``SINGLES`` most frequent words
are classes of their own, all others fall into ``SHARED`` classes by their hash. The class is
predicted by a softmax over hashed features of the history: the last word, the one before it
(a skip), and the two together. Inside a shared class a word has its smoothed share.

Counts come from all training documents. The weights start from how often each feature is
followed by each class, as shrunk log ratios (a pass that counts), and are then trained by
``ROUNDS`` synchronous gradient updates, each a pass over all training documents: the gradient is
the observed less the expected counts, divided by a bound of its curvature. Equal histories of
some ``TOGETHER`` tokens are written as one row with their number, which the passes read, as an
expectation is the same for all of them. A position's scores are products of the powers of its
features' weights, which are taken once in a task. Tasks only add whole
numbers (expected counts in units of 1 / ``UNIT``), so weights and scores do not depend on how the
table is split. The sums of the tasks meet in two steps, first those of ``SIBLINGS`` tasks.
Scoring is one pass in numpy; counts of rare words, too many to hand to every task, are joined by
word hash. Words with at least N / 2**20 occurrences, so at most 2**20 of them, go to every task.

Words are compared by a 64-bit hash. Defined cases: a null or empty text has one token, its
end; a null id counts as an empty text in crc32, so it trains; repeated rows count and are
scored each, with equal scores; words of equal count are ranked by their hash; very long texts
count whole; only ``doc_id`` and the text are read, so other columns may have any name; without
training documents every word's base is log10(1) = 0 and classes are equally likely; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import in_arrow, text_or_empty
from orderlens.llm.textbytes import joined, lowered, mix, places, slices, slots, words
from orderlens.session import stage

SINGLES, SHARED = 96, 32
CLASSES = SINGLES + SHARED
#: Buckets of each of the three feature kinds.
BUCKETS = 1 << 12
KINDS = 3
HEAD = 1 << 20
ROUNDS, MINIBATCH, RATE = 3, 1 << 14, 0.7
#: Share of a feature's log ratio it starts with, as KINDS features speak at once, and the occurrences its prior is worth.
START_SHARE, PRIOR = 1 / KINDS, 20.0
#: Positions whose scores are computed together, so that they stay in the cache.
ABREAST = 1 << 10
#: Parts of one expected occurrence; RARELY * RUN times as many stay below 2**31.
UNIT, RARELY = 1 << 18, 3
#: Positions that are summed together before the whole sum.
RUN = 1 << 11
#: Tasks whose sums meet first.
SIBLINGS = 16
#: Features that occur up to so many times in a minibatch are summed together, an occurrence at a time.
FEW = 48
#: Tokens whose equal histories are counted together.
TOGETHER, TOGETHER_ROW = 1 << 21, 1 << 16
#: Rows of the weight matrix that travel as one row of a frame.
CHUNK = 64
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_KIND = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by its end, and the texts' offsets among them."""
    data, offsets = joined(column)
    hashes, _, _, bounds = words(lowered(data), offsets)
    texts = len(bounds) - 1
    at = bounds + np.arange(texts + 1)
    out = np.full(len(hashes) + texts, END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(texts), np.diff(bounds))] = hashes
    return out, at


def features(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the weight matrix that each position's history switches on, one for each kind."""
    first = at[:-1]
    one = np.empty_like(token)
    one[1:], one[first] = token[:-1], START
    two = np.empty_like(token)
    two[2:], two[first] = token[:-2], START
    second = first[np.diff(at) > 1] + 1
    two[second] = START
    both = (one * _KIND[0], two * _KIND[1], one * _KIND[2] + mix(two))
    return np.stack([(mix(x) & np.uint64(BUCKETS - 1)).astype(np.int64) + k * BUCKETS for k, x in enumerate(both)])


class Vocabulary:
    """Counts of the frequent words, the classes, and the totals behind the base."""

    def __init__(self, hashes, counts, singles, total, kinds, shared_total, shared_kinds):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.kinds = total, kinds
        self.shared_total, self.shared_kinds = shared_total, shared_kinds
        self.single = np.full(len(self.hashes), -1, np.int64)
        if len(singles):
            self.single[np.searchsorted(self.hashes, singles)] = np.arange(len(singles))

    @cached_property
    def slot(self) -> np.ndarray:
        """Made where it is used, not sent along."""
        return slots(self.hashes)

    def find(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its count where the word is frequent, else -1."""
        cls = SINGLES + (token % np.uint64(SHARED)).astype(np.int64)
        count = np.full(len(token), -1, np.int64)
        if len(self.hashes):
            i = np.minimum(places(self.hashes, self.slot, token), len(self.hashes) - 1)
            hit = self.hashes[i] == token
            count[hit] = self.counts[i[hit]]
            own = np.where(hit, self.single[i], -1)
            cls = np.where(own >= 0, own, cls)
        return cls, count

    def bias(self) -> np.ndarray:
        own = np.zeros(CLASSES)
        own[self.single[self.single >= 0]] = self.counts[self.single >= 0]
        own[SINGLES:] = self.shared_total
        unused = (own == 0) & (np.arange(CLASSES) < SINGLES)
        out = np.log((own + 0.5) / (own.sum() + 0.5 * CLASSES))
        out[unused] = -30.0  # no word is in these
        return out.astype(np.float32)


def powers(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """e to the weights, with the bias in those of the first kind: their products are the classes' scores.

    A weight starts with at most a third of a log ratio and grows by less than RATE in a round, so
    that the products of KINDS of them are ordinary numbers.
    """
    out = np.exp(weights)
    out[:BUCKETS] *= np.exp(bias)
    return out


def scored(power: np.ndarray, active: np.ndarray, held: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the classes for each position, in ``held``, and their sums."""
    out, other = (x[: active.shape[1]] for x in held)
    np.take(power, active[0], 0, out, "clip")
    for row in active[1:]:
        np.take(power, row, 0, other, "clip")
        out *= other
    return out, np.vecdot(out, np.ones(CLASSES, np.float32))


def abreast() -> tuple[np.ndarray, np.ndarray]:
    return np.empty((ABREAST, CLASSES), np.float32), np.empty((ABREAST, CLASSES), np.float32)


def forward(weights: np.ndarray, bias: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes for each position."""
    z = weights[active].sum(0) + bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def log_shares(weights: np.ndarray, bias: np.ndarray, power: np.ndarray, active: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Log probability of each position's class, that which ``forward`` gives it."""
    out = weights[active, cls].sum(0, dtype=np.float64)
    out += bias[cls]
    held = abreast()
    for low in range(0, len(cls), ABREAST):
        out[low : low + ABREAST] -= np.log(scored(power, active[:, low : low + ABREAST], held)[1])
    return out


def add_observed(total: np.ndarray, active: np.ndarray, cls: np.ndarray, times: np.ndarray | None = None) -> None:
    """Count the classes that follow each feature, every position ``times`` (once)."""
    for row in active:
        np.add.at(total.reshape(-1), row * CLASSES + cls, 1 if times is None else times)


def add_expected(total: np.ndarray, weights: np.ndarray, bias: np.ndarray, active: np.ndarray, times: np.ndarray | None = None) -> None:
    """Add, for every feature that occurs, the probabilities of the classes in whole units, every position ``times`` (once)."""
    add_shares(total, powers(weights, bias), active, times)


def add_shares(total: np.ndarray, power: np.ndarray, active: np.ndarray, times: np.ndarray | None = None) -> None:
    """``add_expected`` of the weights behind ``power``, for up to ``MINIBATCH`` positions at a time."""
    held = abreast()
    rarely = times is None or times.max(initial=0) <= RARELY
    whole = np.empty((min(MINIBATCH, active.shape[1]), CLASSES), np.int32 if rarely else np.int64)
    for start in range(0, active.shape[1], MINIBATCH):
        own = active[:, start : start + MINIBATCH]
        share = whole[: own.shape[1]]
        for low in range(0, len(share), ABREAST):
            score, every = scored(power, own[:, low : low + ABREAST], held)
            score *= (np.float32(UNIT) / every)[:, None]
            share[low : low + ABREAST] = np.rint(score, out=score)
        if times is not None:
            share *= times[start : start + MINIBATCH, None].astype(share.dtype)
        for row in own:
            add_by_row(total, share, row)


def add_by_row(total: np.ndarray, share: np.ndarray, row: np.ndarray) -> None:
    """``np.add.at(total, row, share)``, an occurrence of all rows at a time, frequent rows each by itself."""
    order = np.argsort(row.astype(np.int16), kind="stable")  # a radix sort; rows are below 2**15
    row = row[order]
    head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    size = np.diff(np.append(head, len(row)))
    frequent = np.argsort(-size, kind="stable")
    head, size, row = head[frequent], size[frequent], row[head[frequent]]
    held = np.empty((RUN, share.shape[1]), share.dtype)
    many = int(np.searchsorted(-size, -FEW))
    for one, start, end in zip(row[:many].tolist(), head[:many].tolist(), (head + size)[:many].tolist(), strict=True):
        for low in range(start, end, RUN):
            at = order[low : min(low + RUN, end)]
            # rows that are sorted already stand together
            near = share[at[0] : at[-1] + 1] if at[-1] - at[0] + 1 == len(at) else np.take(share, at, 0, held[: len(at)], "clip")
            total[one] += near.sum(0, dtype=share.dtype)
    for low in range(many, len(row), RUN):
        first, n = head[low : low + RUN], size[low : low + RUN]
        part = share[order[first]]
        for j in range(1, int(n[0])):
            upto = int(np.searchsorted(-n, -j))  # those that occur more than j times
            part[:upto] += np.take(share, order[first[:upto] + j], 0, held[:upto], "clip")
        total[row[low : low + RUN]] += part


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        token, _ = tokens(batch.column("text"))
        word, n = np.unique(token, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])


def vocabulary(training: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """All words' counts, as a table in the shared folder, and what goes to every task."""
    counts = stage(in_arrow(training.select("text"), count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "word-counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.where(F.col("n") * HEAD >= total).toPandas()
    head = head.sort_values(["n", "w"], ascending=[False, True])
    hashes, n = head["w"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64)
    singles = hashes[:SINGLES]
    # hashes are unsigned: the remainder of a negative long is corrected by that of 2**64, which SHARED divides
    rest = counts.where(~F.col("w").isin([int(x) for x in singles.view(np.int64)])).groupBy(F.pmod("w", F.lit(SHARED)).alias("c"))
    shared_total, shared_kinds = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for row in rest.agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        shared_total[row.c], shared_kinds[row.c] = row.n, row.v
    return counts, Vocabulary(hashes, n, singles, total, kinds, shared_total, shared_kinds)


def coded(active: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """A position's features and the class that follows as one number, the class last."""
    code = np.zeros(len(cls), np.int64)
    for k, row in enumerate(active):
        code = code * BUCKETS + (row - k * BUCKETS)
    return code * CLASSES + cls


def features_of(history: np.ndarray) -> np.ndarray:
    """The features in codes without their class."""
    return np.stack([history // BUCKETS ** (KINDS - 1 - k) % BUCKETS + k * BUCKETS for k in range(KINDS)])


def packed(code: np.ndarray) -> bytes:
    """Sorted codes: first the lower halves of all, then the higher ones, which hardly change and so take no room."""
    return code.astype(np.uint32).tobytes() + (code >> 32).astype(np.uint16).tobytes()


def unpacked(data: pa.Buffer) -> np.ndarray:
    n = data.size // 6
    return np.frombuffer(data, np.uint32, n).astype(np.int64) | np.frombuffer(data, np.uint16, n, 4 * n).astype(np.int64) << 32


def histories(training: DataFrame, known: Broadcast) -> DataFrame:
    """Rows of up to ``TOGETHER_ROW`` codes (see ``coded``), sorted and ``packed``, and n, how often each occurs among some
    ``TOGETHER`` tokens. A code may be in several rows."""

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(code), TOGETHER_ROW):
            own = slice(k, k + TOGETHER_ROW)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (packed(code[own]), n[own].astype(np.int64).tobytes())], ["code", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                token, at = tokens(batch.column("text"))
                held.append(coded(features(token, at), known.value.find(token)[0]))
                if sum(map(len, held)) >= TOGETHER:
                    yield from counted(held)
                    held = []
        if held:
            yield from counted(held)

    return stage(in_arrow(training.select("text"), work, "code binary, n binary"), "histories")


def summed(seen: DataFrame, model: Broadcast | None) -> np.ndarray:
    """Counts by feature and class over all ``histories``: observed ones, or those a model expects."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((KINDS * BUCKETS, CLASSES), np.int64)
        power = None if model is None else powers(*model.value)
        rows = ((unpacked(code.as_buffer()), np.frombuffer(n.as_buffer(), np.int64)) for batch in batches for code, n in zip(*batch.columns, strict=True))
        for code, n in rows:
            if model is None:
                add_observed(total, features_of(code // CLASSES), code % CLASSES, n)
                continue
            history = code // CLASSES
            head = np.flatnonzero(np.append(True, history[1:] != history[:-1]))
            history, n = history[head], np.add.reduceat(n, head)
            # nearly all occur once or little more: their sums stay below 2**31
            for some in (n <= RARELY, n > RARELY):
                add_shares(total, power, features_of(history[some]), n[some])
        chunks = {k // CHUNK: total[k : k + CHUNK] for k in range(0, len(total), CHUNK) if total[k : k + CHUNK].any()}
        yield as_rows(chunks, TaskContext.get().partitionId() // SIBLINGS)

    def as_rows(chunks: dict[int, np.ndarray], branch: int = 0) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary())
        values = (list(chunks), [branch] * len(chunks), [x.tobytes() for x in chunks.values()])
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds, strict=True)], ["chunk", "branch", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part"), strict=True):
                own = np.frombuffer(part.as_buffer(), np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own.copy()
        yield as_rows(sums)

    schema = "chunk int, branch int, part binary"
    parts = in_arrow(seen, work, schema)
    for keys in (("chunk", "branch"), ("chunk",)):
        parts = parts.repartition(*keys).mapInArrow(add, schema)
    out = np.zeros((KINDS * BUCKETS, CLASSES), np.int64)
    for row in parts.collect():
        own = np.frombuffer(row.part, np.int64).reshape(-1, CLASSES)
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(own)] += own
    return out


def first_weights(observed: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A share of the log of how much more often a class follows a feature than it occurs at all."""
    plain = np.exp(bias.astype(np.float64))
    plain /= plain.sum()
    n = observed.sum(1, keepdims=True)
    return (START_SHARE * np.log((observed + PRIOR * plain) / ((n + PRIOR) * plain))).astype(np.float32)


def updated(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """One step along the gradient, observed less expected counts, over a bound of its curvature."""
    return weights + (RATE * (observed - expected) / (np.maximum(observed, expected) + PRIOR)).astype(np.float32)


def train(training: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by classes) and bias."""
    context = training.sparkSession.sparkContext
    bias, known = vocab.bias(), context.broadcast(vocab)
    # a task sends sums of fixed size, so it should have that many tokens
    seen = histories(training, known).coalesce(int(vocab.total) // TOGETHER + 1)
    observed = summed(seen, None)
    weights = first_weights(observed, bias)
    for _ in range(ROUNDS):
        model = context.broadcast((weights, bias))
        weights = updated(weights, observed, summed(seen, model) / UNIT)
        model.unpersist()
    return weights, bias


def score(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    rows = docs.select("doc_id", held.alias("held_out"), text_or_empty(column).alias("text"))
    training = rows.where("not held_out")
    counts, vocab = vocabulary(training)
    weights, bias = train(training, vocab)
    model = docs.sparkSession.sparkContext.broadcast((vocab, weights, bias))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, b = model.value
        power = powers(w, b)
        denominator = np.log10(known.total + 0.5 * (known.kinds + 1))
        inside = np.log10(known.shared_total + 0.5 * (known.shared_kinds + 1))
        serial = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                token, at = tokens(batch.column("text"))
                cls, count = known.find(token)
                log = log_shares(w, b, power, features(token, at), cls) / np.log(10)
                shared = cls >= SINGLES
                log[shared] -= inside[cls[shared] - SINGLES]
                frequent = count >= 0
                smooth = np.where(frequent, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                log += np.where(shared, smooth, 0.0)
                base = smooth - denominator
                first = at[:-1]
                text = np.repeat(np.arange(len(first)), np.diff(at))
                rare = np.flatnonzero(~frequent)
                pair = np.lexsort((token[rare], text[rare]))
                t, d = token[rare][pair], text[rare][pair]
                head = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))) if len(t) else np.zeros(0, np.int64)
                times = np.diff(np.append(head, len(t)))
                ends = np.concatenate(([0], np.cumsum(np.bincount(d[head], minlength=len(first))))).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(t[head].view(np.int64)), pa.array(times.astype(np.int64))], ["w", "tf"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(serial + np.arange(len(first))), batch.column("doc_id"), batch.column("held_out"),
                        pa.array(np.diff(at)), pa.array(np.add.reduceat(frequent, first, dtype=np.int64)),
                        pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(log, first)),
                        pa.ListArray.from_arrays(pa.array(ends), pairs),
                    ],
                    ["key", "doc_id", "held_out", "n_tokens", "known", "base", "log", "rare"],
                )
                serial += len(first)

    schema = f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, log double, rare array<struct<w:bigint,tf:bigint>>"
    found = stage(in_arrow(rows, look_up, schema), "scores")
    each = found.select("key", F.explode("rare").alias("r")).select("key", "r.w", "r.tf").join(counts, "w", "left")
    smooth = F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    rest = each.groupBy("key").agg(F.sum(smooth).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("met"))
    more = F.coalesce("more", F.lit(0.0))
    return found.drop("rare").join(rest, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(int(vocab.total)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("log") + more).alias("score"),
    )
