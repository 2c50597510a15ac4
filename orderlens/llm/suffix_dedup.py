"""Suffix-array dedup: remove bytes of 100-byte strings that start earlier in the corpus.

Earlier is a smaller document id, or the same document and a smaller start. Every window of
``WINDOW`` bytes holds an anchor: a position whose ``GRAM`` bytes have the smallest hash among
those of the window. Equal windows hold equal anchors at equal places, so only occurrences of
one anchor have to be compared, each by its context, the bytes that windows around it cover.

1. Each task finds its anchors and folds equal contexts to the earliest; the others are repeats.
2. Dealt out by anchor and sorted, the rows stream past: after the first of equal contexts all
   are repeats; first ones of an anchor with several contexts go on.
3. Their contexts are fetched and dealt out by anchor. A block of whole anchor groups is one
   text of 10-byte symbols, whose suffix array (``suffix_array``) brings runs with nine equal
   symbols together; every 100-byte window holds nine, so windows that occur twice lie in one
   run, and comparing the ends that stick out of the symbols verifies them byte by byte.
   Anchors with more than ``MANY`` contexts don't meet in one task: each of their windows is
   dealt out by its own hash and streams past as in step 2.
4. Each document gets its intervals and gives up the bytes under them.

Defined cases: a null text is empty; texts shorter than a window keep all their bytes; a null
id counts as smaller than all others; documents of one id are told apart and ordered by a 64-bit
hash of their text, the mark ``m`` that goes with the id ``d`` through all steps, and rows with equal id and text are one document, with equal results; an empty table gives no
rows. A text is cut into overlapping pieces for hashing, so memory for scratch arrays is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from orderlens.llm.common import apart, bounded_batches, in_arrow
from orderlens.llm.suffix_array import suffix_array
from orderlens.llm.textbytes import joined, mix, seeds, slices, whole_groups
from orderlens.session import stage

WINDOW, GRAM = 100, 32
#: Places of an anchor inside a window; bytes of context before it and from it on.
SPREAD = WINDOW - GRAM
BEFORE, AFTER = SPREAD, WINDOW
CONTEXT = BEFORE + AFTER
SYMBOL = 10
#: Whole symbols in any window, and in a context.
INSIDE, SYMBOLS = (WINDOW - SYMBOL + 1) // SYMBOL, CONTEXT // SYMBOL
#: Contexts of an anchor up to which it is one group of the suffix array.
MANY = 512
PIECE = 1 << 18
NO_ID = -(2**63)

_SEED = seeds(CONTEXT // 8 + 4, 61)
_LEAD = np.array([(0xFFFFFFFFFFFFFFFF << 8 * k) & 0xFFFFFFFFFFFFFFFF for k in range(9)], np.uint64)
_TRAIL = np.array([0xFFFFFFFFFFFFFFFF >> 8 * k for k in range(8)] + [0], np.uint64)
COPY, FIRST, FIRST_OF_MANY = range(1, 4)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as an integer (unaligned view; padded at the end)."""
    padded = np.concatenate((data, np.zeros(7, np.uint8)))
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) over ``width`` values from each position on; shorter at the end."""
    out, span = values, 1
    while span * 2 <= width:
        new = out.copy()
        least(out[:-span], out[span:], out=new[:-span])
        out, span = new, span * 2
    if span < width:
        new = out.copy()
        rest = width - span
        least(out[:-rest], out[rest:], out=new[:-rest])
        out = new
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all anchors and their hashes; windows don't cross the offsets."""
    n = len(data)
    size = np.diff(offsets)
    if not (size >= WINDOW).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    eight = eights(data)
    half = np.zeros(n, np.uint64)
    half[:-8] = mix(eight[:-8] * _SEED[0] + (eight[8:] ^ _SEED[1]) * _SEED[2])
    value = np.zeros(n, np.uint64)
    value[:-16] = mix(half[:-16] * _SEED[3] + half[16:])
    value |= np.uint64(1)  # zero marks what is no window
    valid = np.zeros(n + 1, np.int8)
    whole = size >= WINDOW
    np.add.at(valid, offsets[:-1][whole], 1)
    np.add.at(valid, offsets[1:][whole] - WINDOW + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    low = np.where(valid, sliding(value, SPREAD + 1, np.minimum), np.uint64(0))
    most = sliding(low[::-1], SPREAD + 1, np.maximum)[::-1]  # over the windows that hold a position
    at = np.flatnonzero(most == value)
    return at, value[at]


def context_hashes(data: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of the ``before`` bytes in front of each position and the ``after`` bytes from it on."""
    padded = np.concatenate((np.zeros(BEFORE, np.uint8), data, np.zeros(AFTER + 8, np.uint8)))
    eight = eights(padded)
    total = before.astype(np.uint64) * _SEED[-1] + after.astype(np.uint64) * _SEED[-2]
    for j in range(CONTEXT // 8):
        lead = np.clip(BEFORE - before - 8 * j, 0, 8)
        trail = np.clip(8 * j + 8 - BEFORE - after, 0, 8)
        part = eight[at + 8 * j] & _LEAD[lead] & _TRAIL[trail]
        total += mix((part ^ _SEED[j]) * _SEED[j + 1])
    return mix(total)


def folded(h: np.ndarray, c: np.ndarray, d: np.ndarray, m: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Rows (h, c, d, m, at, kind) with repeats of equal (h, c) marked as copies and dealt out by place."""
    order = np.lexsort((at, m, d, c, h))
    h, c, d, m, at = h[order], c[order], d[order], m[order], at[order]
    equal = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    # equal places after an equal place are the same one (rows repeated, pieces overlapping)
    same = np.zeros(len(h), bool)
    same[1:] = equal & (d[1:] == d[:-1]) & (m[1:] == m[:-1]) & (at[1:] == at[:-1])
    again = np.zeros(len(h), bool)
    again[1:] = equal & ~same[1:]
    kept = ~same
    h, c, d, m, at, again = h[kept], c[kept], d[kept], m[kept], at[kept], again[kept]
    h = np.where(again, mix(d.view(np.uint64) * np.uint64(3) + m.view(np.uint64) * np.uint64(5) + at.view(np.uint64)), h)
    return [h.view(np.int64), c.view(np.int64), d, m, at, np.where(again, COPY, FIRST).astype(np.int32)]


PLACES = "h long, c long, d long, m long, at long, kind int"
PLACE_NAMES = ["h", "c", "d", "m", "at", "kind"]


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            data, offsets = joined(batch.column("text"))
            ids, marks = batch.column("d").to_numpy(), batch.column("m").to_numpy()
            found: list[list[np.ndarray]] = []
            first = 0
            # runs of texts of about a piece, or overlapping pieces of one long text
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
                low, high = int(offsets[first]), int(offsets[last])
                for a in range(low, max(high - WINDOW + 1, low + 1), PIECE if last == first + 1 else max(high - low, 1)):
                    b = min(a + PIECE + WINDOW - 1, high) if last == first + 1 else high
                    inner = offsets[first : last + 1] - a if last > first + 1 else np.array([0, b - a])
                    at, h = anchors(data[a:b], inner)
                    at = at + a
                    doc = np.searchsorted(offsets, at, "right") - 1
                    before = np.minimum(at - offsets[doc], BEFORE)
                    after = np.minimum(offsets[doc + 1] - at, AFTER)
                    lo, hi = max(a - BEFORE, 0), min(b + AFTER, len(data))
                    c = context_hashes(data[lo:hi], at - lo, before, after)
                    found.append([h, c, ids[doc], marks[doc], at - offsets[doc]])
                first = last
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in folded(*(np.concatenate(x) for x in zip(*found, strict=True)))], PLACE_NAMES)


def after_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, c, d, m, at): copies as they are, later ones of equal (h, c) as copies,
    first ones of an ``h`` with several ``c`` as FIRST or, of more than ``MANY``, FIRST_OF_MANY.

    Streams: what is held back is at most ``MANY`` rows of one ``h``.
    """
    names = PLACE_NAMES
    last_h = last_c = last_place = None
    held: list[np.ndarray] = []
    many = False

    def flush(rows: list[np.ndarray]) -> np.ndarray:
        out = np.concatenate(rows, 1) if rows else np.zeros((len(names), 0), np.int64)
        return out if out.shape[1] > 1 else out[:, :0]

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        rows = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in names])
        out = [rows[:, rows[-1] == COPY]]
        rows = rows[:, rows[-1] != COPY]
        if rows.shape[1]:
            new_h = np.append(True if last_h is None else rows[0, 0] != last_h, rows[0, 1:] != rows[0, :-1])
            new_c = new_h | np.append(last_c is None or rows[1, 0] != last_c, rows[1, 1:] != rows[1, :-1])
            place = rows[2:-1]
            moved = np.append(last_place is None or bool((place[:, 0] != last_place).any()), (place[:, 1:] != place[:, :-1]).any(0))
            last_h, last_c, last_place = rows[0, -1], rows[1, -1], place[:, -1].copy()
            copies = rows[:, ~new_c & moved].copy()
            copies[-1] = COPY
            out.append(copies)
            rows, new_h = rows[:, new_c].copy(), new_h[new_c]
            rows[-1] = FIRST
            cut = np.flatnonzero(new_h)
            ends = np.append(cut[1:], rows.shape[1]) if len(cut) else np.zeros(0, np.int64)
            head = rows[:, : cut[0]] if len(cut) else rows  # goes on with the h held back
            if head.shape[1]:
                if many:
                    head[-1] = FIRST_OF_MANY
                    out.append(head)
                else:
                    held.append(head.copy())
                    if sum(x.shape[1] for x in held) > MANY:
                        many, start = True, np.concatenate(held, 1)
                        start[-1] = FIRST_OF_MANY
                        out.append(start)
                        held = []
            if len(cut):
                if not many:
                    out.append(flush(held))
                length = ends - cut
                inner = rows[:, cut[0] : cut[-1]]
                size = np.repeat(length[:-1], length[:-1])
                inner[-1] = np.where(size > MANY, FIRST_OF_MANY, FIRST)
                out.append(inner[:, size > 1])
                tail = rows[:, cut[-1] :].copy()
                many = tail.shape[1] > MANY
                held = [] if many else [tail]
                if many:
                    tail[-1] = FIRST_OF_MANY
                    out.append(tail)
        done = np.concatenate(out, 1)
        if done.shape[1]:
            yield pa.RecordBatch.from_arrays([*map(pa.array, done[:-1]), pa.array(done[-1].astype(np.int32))], names)
    if not many:
        done = flush(held)
        if done.shape[1]:
            yield pa.RecordBatch.from_arrays([*map(pa.array, done[:-1]), pa.array(done[-1].astype(np.int32))], names)


def starts_of(found: list | None) -> np.ndarray:
    """Columns (start, kind or stop, h) of a text's places."""
    return np.array([(x["at"], x["kind"], x["h"]) for x in found or []], np.int64).reshape(-1, 3)


def fetch_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            data, offsets = joined(batch.column("text"))
            ids, marks = batch.column("d").to_numpy(), batch.column("m").to_numpy()
            padded = np.concatenate((np.zeros(BEFORE, np.uint8), data, np.zeros(AFTER, np.uint8)))
            for i, found in enumerate(batch.column("found")):
                rows = starts_of(found.as_py())
                for low in range(0, len(rows), 4096):
                    start, kind, h = rows[low : low + 4096].T
                    base = offsets[i] + start
                    text = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[base]
                    before = np.minimum(start, BEFORE)
                    after = np.minimum(offsets[i + 1] - base, AFTER)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h), pa.array(np.full(len(h), ids[i])), pa.array(np.full(len(h), marks[i])), pa.array(start), pa.array(kind.astype(np.int32)),
                            pa.array((BEFORE - before).astype(np.int32)), pa.array((BEFORE + after).astype(np.int32)),
                            pa.FixedSizeBinaryArray.from_buffers(pa.binary(CONTEXT), len(h), [None, pa.py_buffer(np.ascontiguousarray(text))]).cast(pa.binary()),
                        ],
                        ["h", "d", "m", "at", "kind", "low", "high", "context"],
                    )


CONTEXTS = "h long, d long, m long, at long, kind int, low int, high int, context binary"


def compare(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(d, m, at, stop) of the intervals that a block of whole anchor groups covers by earlier windows."""
    order = np.lexsort([part.column(k).to_numpy() for k in ("at", "m", "d", "h")])
    ids, marks, at, low, high = (part.column(k).to_numpy()[order].astype(np.int64) for k in ("d", "m", "at", "low", "high"))
    # documents by number, in the order of their keys
    sort = np.lexsort((marks, ids))
    d = np.empty(len(ids), np.int64)
    d[sort] = np.cumsum(np.append(False, (ids[sort][1:] != ids[sort][:-1]) | (marks[sort][1:] != marks[sort][:-1])))
    raw, _ = joined(part.column("context"))
    text = raw.reshape(-1, CONTEXT)[order]
    n = len(text)
    # one symbol for each 10 bytes, and one of its own after each context
    cells = np.ascontiguousarray(text[:, : SYMBOLS * SYMBOL]).reshape(-1, SYMBOL)
    a = np.ascontiguousarray(cells[:, :8]).view("<u8").reshape(-1)
    b = np.ascontiguousarray(cells[:, 8:]).view("<u2").reshape(-1)
    sort = np.lexsort((b, a))
    step = np.append(False, (a[sort][1:] != a[sort][:-1]) | (b[sort][1:] != b[sort][:-1]))
    code = np.empty(len(cells), np.int64)
    code[sort] = np.cumsum(step) + n + 1
    line = np.column_stack([code.reshape(n, SYMBOLS), np.arange(1, n + 1)]).reshape(-1)
    array = np.array(suffix_array(line.tolist()), np.int64)
    row, place = array // (SYMBOLS + 1), array % (SYMBOLS + 1)
    fits = place <= SYMBOLS - INSIDE
    array, row, place = array[fits], row[fits], place[fits]
    # runs of neighbours with INSIDE equal symbols
    view = np.lib.stride_tricks.sliding_window_view(line, INSIDE)
    new = np.append(True, (view[array[1:]] != view[array[:-1]]).any(1))
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    several = size[run] > 1
    run, row, place = run[several], row[several], place[several]
    # the windows whose first whole symbol is the run's, told apart by the bytes that stick out
    out = np.tile(np.arange(SYMBOL), len(run))
    run, row, place = (np.repeat(x, SYMBOL) for x in (run, row, place))
    start = place * SYMBOL - out
    good = (start >= low[row]) & (start + WINDOW <= high[row]) & (start <= SPREAD)
    run, row, out, start = run[good], row[good], out[good], start[good]
    if not len(run):
        return (np.zeros(0, np.int64),) * 4
    inner = np.arange(SYMBOL)
    column = np.where(inner[None, :] < out[:, None], start[:, None] + inner, start[:, None] + INSIDE * SYMBOL + inner)
    ends = text[row[:, None], column]
    ends8 = np.ascontiguousarray(ends[:, :8]).view("<u8").reshape(-1)
    ends2 = np.ascontiguousarray(ends[:, 8:]).view("<u2").reshape(-1)
    kind = run * SYMBOL + out
    begin = at[row] + start  # as BEFORE bytes come first, this is BEFORE more than the window's place
    sort = np.lexsort((begin, d[row], ends2, ends8, kind))
    same = (kind[sort][1:] == kind[sort][:-1]) & (ends8[sort][1:] == ends8[sort][:-1]) & (ends2[sort][1:] == ends2[sort][:-1])
    # later than the first of its group, unless it is at the first one's place
    group = np.cumsum(np.append(True, ~same)) - 1
    head = np.flatnonzero(np.append(True, ~same))
    again = (d[row][sort] != d[row][sort][head][group]) | (begin[sort] != begin[sort][head][group])
    hit = sort[again]
    row, begin = row[hit], begin[hit] - BEFORE
    sort = np.lexsort((begin, d[row]))
    row, begin = row[sort], begin[sort]
    edge = np.append(True, (d[row][1:] != d[row][:-1]) | (begin[1:] > begin[:-1] + WINDOW)) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(row)) - 1
    return ids[row[first]], marks[row[first]], begin[first], begin[last] + WINDOW if len(row) else begin


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in whole_groups(batches, ["h"], rows=2_000, size=4 << 20):
        yield pa.RecordBatch.from_arrays([*map(pa.array, compare(part))], ["d", "m", "at", "stop"])


def single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each context as rows of their own, named by two hashes."""
    span = WINDOW // 4
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, _ = joined(batch.column("context"))
        text = raw.reshape(-1, CONTEXT)
        d, m, at, low, high = (batch.column(k).to_numpy().astype(np.int64) for k in ("d", "m", "at", "low", "high"))
        four = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 4, 1)).view("<u4")[..., 0].astype(np.uint64)
        found = []
        for start in range(SPREAD + 1):
            good = np.flatnonzero((start >= low) & (start + WINDOW <= high))
            one, two = np.zeros(len(good), np.uint64), np.zeros(len(good), np.uint64)
            for k in range(span):
                x = four[good, start + 4 * k]
                one = (one ^ x) * _SEED[0] + (one >> np.uint64(29))
                two = (two + x) * _SEED[1] ^ (two >> np.uint64(31))
            found.append([mix(one), mix(two), d[good], m[good], at[good] - BEFORE + start])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in folded(*(np.concatenate(x) for x in zip(*found, strict=True)))], PLACE_NAMES)


def document_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_mark(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")).cast("binary"))


def repeats(docs: DataFrame, column: str = "text") -> DataFrame:
    """(d, m, found) with the places of each document: starts of intervals, and their ends (0: an anchor's context)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(document_key().alias("d"), text_mark(column).alias("m"), F.coalesce(F.col(column), F.lit("")).cast("binary").alias("text"))
    rows = in_arrow(texts, find_anchors, PLACES)
    marked = stage(rows.repartition("h").sortWithinPartitions("h", "c", "d", "m", "at").mapInArrow(after_first, PLACES), "anchors")
    wanted = marked.where(f"kind <> {COPY}").groupBy("d", "m").agg(F.collect_list(F.struct("at", "kind", "h")).alias("found"))
    contexts = stage(texts.join(wanted.hint("shuffle_hash"), ["d", "m"]).mapInArrow(fetch_contexts, CONTEXTS), "contexts")
    few = contexts.where(f"kind = {FIRST}").repartition("h").sortWithinPartitions("h").mapInArrow(compare_blocks, "d long, m long, at long, stop long")
    windows = contexts.where(f"kind = {FIRST_OF_MANY}").mapInArrow(single_windows, PLACES)
    windows = windows.repartition("h").sortWithinPartitions("h", "c", "d", "m", "at").mapInArrow(after_first, PLACES).where(f"kind = {COPY}")
    places = marked.where(f"kind = {COPY}").select("d", "m", "at", F.lit(0).cast("long").alias("stop"))
    places = places.unionByName(few).unionByName(windows.select("d", "m", "at", (F.col("at") + WINDOW).alias("stop")))
    return places.groupBy("d", "m").agg(F.collect_list(F.struct("at", F.col("stop").alias("kind"), F.lit(0).cast("long").alias("h"))).alias("found"))


def covered(found: list | None, size: int) -> np.ndarray:
    """For each byte of a text whether one of its intervals covers it."""
    rows = starts_of(found)
    start, stop = rows[:, 0], rows[:, 1]
    anchor = rows[:, 1] == 0
    first = np.where(anchor, np.maximum(start - BEFORE, 0), start)
    stop = np.where(anchor, np.minimum(start + AFTER, size), stop)
    depth = np.bincount(first, minlength=size + 1) - np.bincount(stop, minlength=size + 1)
    return np.cumsum(depth[:size]) > 0


def dedup(docs: DataFrame, keep: list[str], replace: bool, column: str = "text") -> DataFrame:
    """``keep`` columns of all rows and n_bytes, n_removed, n_spans, kept_sha256; with ``replace``
    instead all columns, the text without its repeats (bytes left of cut characters go too)."""
    found = repeats(docs, column)
    given = docs.withColumn("_d", document_key()).withColumn("_m", text_mark(column))
    given = given.join(found.select(F.col("d").alias("_d"), F.col("m").alias("_m"), F.col("found").alias("_found")).hint("shuffle_hash"), ["_d", "_m"], "left")
    given = given.select(*dict.fromkeys([*keep, column]), "_found")
    names = [*keep] if replace else [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = StructType([docs.schema[c] for c in keep])
    if not replace:
        for name in names[-4:-1]:
            schema = schema.add(name, LongType())
        schema = schema.add("kept_sha256", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                data, offsets = joined(batch.column(column))
                made, texts = [], []
                for i, places in enumerate(batch.column("_found")):
                    own = data[offsets[i] : offsets[i + 1]]
                    gone = covered(places.as_py(), len(own)) if places.is_valid else np.zeros(len(own), bool)
                    left = own[~gone].tobytes()
                    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                    made.append((len(own), int(gone.sum()), spans))
                    texts.append(left)
                if replace:
                    null = batch.column(column).is_null().to_pylist()
                    fresh = pa.array([None if n else t.decode("utf-8", "ignore") for n, t in zip(null, texts, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([fresh if c == column else batch.column(c) for c in names], names)
                    continue
                made = np.array(made, np.int64).reshape(-1, 3)
                digests = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(made[:, k]) for k in range(3)), digests], names)

    return given.mapInArrow(work, schema)


def removed_bytes(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return dedup(docs.select("doc_id", column), ["doc_id"], False, column)


def without_repeats(docs: DataFrame, column: str = "text") -> DataFrame:
    """All rows and columns, texts without their repeats; n_chars, if there, counts what is left."""
    given = apart(docs, "doc_id", column)
    out = dedup(given, given.columns, True, column).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(column).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
