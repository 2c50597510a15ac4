"""Words and hashes of a batch of texts as numpy arrays over their UTF-8 bytes.

All functions work on the joined bytes of many texts plus the offsets between them, so a
batch costs a fixed number of vector operations whatever the number of texts. Nulls are
empty texts. Words are the runs ``[^\\x20\\x09-\\x0D]+``; they never cross a text's edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed in one go; bounds the scratch arrays (about 40 bytes for each).
PIECE = 1 << 20
#: Of words that aren't longer than _BLOCK so many, in which the scratch arrays stay in the cache.
NEAR = 1 << 15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = 1 << 12


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (shift, xor, multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit constants by rule."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(salt)) | np.uint64(1)


_BYTE = seeds(256, 11)
_LOW = np.cumprod(np.full(_BLOCK, 0xF1357AEA2E62A9C5, np.uint64))
_POWER = np.cumprod(np.full(NEAR + _BLOCK, 0xF1357AEA2E62A9C5, np.uint64))
_BACK = np.cumprod(np.append(np.uint64(1), np.full(NEAR, pow(0xF1357AEA2E62A9C5, -1, 1 << 64), np.uint64)))
_GRAM = seeds(64, 23)


def joined(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column, without a copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word, in order."""
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are ascending and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    length = ends - starts
    if int(length.max()) <= _BLOCK:
        # powers go on from word to word, each word's sum is brought back to its own first power
        cuts = np.unique(np.searchsorted(starts, np.append(np.arange(starts[0], starts[-1] + 1, NEAR), starts[-1] + 1))).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            first, last = starts[a:b] - starts[a], ends[a:b] - starts[a] - 1
            value = _BYTE[data[starts[a] : ends[b - 1]]]
            value *= _POWER[: len(value)]
            upto = np.cumsum(value)
            out[a:b] = (upto[last] - upto[first] + value[first]) * _BACK[first]
        return mix(out + length.astype(np.uint64) * _BYTE[7])
    total = np.cumsum(length)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, int(total[-1]), PIECE), "left"), len(starts)))
    if cuts[0]:
        cuts = np.append(0, cuts)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = length[a:b]
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begin, n)
        at = inner + np.repeat(starts[a:b], n)
        value = _BYTE[data[at]] * _LOW[inner & (_BLOCK - 1)]
        if int(n.max()) > _BLOCK:
            value = value * mix((inner >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        out[a:b] = np.add.reduceat(value, begin) + n.astype(np.uint64) * _BYTE[7]
    return mix(out)


def words(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end of every word and the first word's number of every text (with the total at the end)."""
    starts, ends = word_spans(data, offsets, space)
    return span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets, "left")


def slots(known: np.ndarray) -> np.ndarray:
    """Where the hashes that share their first bits begin among sorted ones: about a slot for each."""
    bits = max(len(known).bit_length(), 1)
    return np.searchsorted(known, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)


def places(known: np.ndarray, slot: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """``np.searchsorted(known, hashes)``, from the hashes' ``slots`` on instead of by bisection."""
    at = slot[(hashes >> np.uint64(65 - len(slot).bit_length())).view(np.int64)]
    left = np.flatnonzero(at < len(known))
    left = left[known[at[left]] < hashes[left]]
    while len(left):
        at[left] += 1
        left = left[at[left] < len(known)]
        left = left[known[at[left]] < hashes[left]]
    return at


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside one text, and the offsets of the texts among them.

    A text of fewer than ``n`` words, but at least one, has one run: all its words.
    """
    count = np.diff(bounds)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate(([0], np.cumsum(runs)))
    first = np.repeat(bounds[:-1], runs) + np.arange(int(out_at[-1])) - np.repeat(out_at[:-1], runs)
    value = np.zeros(len(first), np.uint64)
    stop = np.repeat(bounds[1:], runs)
    for k in range(n):
        at = first + k
        inside = at < stop
        value += np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))] * _GRAM[k], _GRAM[k + 32]) if len(hashes) else 0
    return mix(value), out_at


def per_text_unique(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text in ascending order, and their offsets."""
    if not len(values):
        return values, np.zeros(len(at), np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[keep], np.concatenate(([0], np.cumsum(np.bincount(text[keep], minlength=len(at) - 1))))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``most`` bytes of text each (one row at least)."""
    sizes = np.diff(joined(batch.column(column))[1])
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by ``keys`` (integers, no nulls).

    A table holds at least ``rows`` rows or ``size`` bytes, cut where the key changes.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held)
        edge = np.zeros(table.num_rows, bool)
        for key in keys:
            value = table.column(key).to_numpy()
            edge[1:] |= value[1:] != value[:-1]
        cut = np.flatnonzero(edge)
        if len(cut):
            yield table.slice(0, int(cut[-1]))
            # combine, so that a small rest doesn't keep the whole table in memory
            held = table.slice(int(cut[-1])).combine_chunks().to_batches()
        else:
            held = table.combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


#: Separators when punctuation is to be ignored: all ASCII but letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without punctuation, and the texts' offsets among them."""
    data, offsets = joined(column)
    hashes, _, _, bounds = words(lowered(data), offsets, PUNCTUATION)
    return hashes, bounds
