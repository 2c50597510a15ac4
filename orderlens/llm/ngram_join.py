"""N-gram Jaccard join: near-duplicate documents by MinHash bands and a check on full sets.

A document's set is its distinct runs of five words (a shorter document's only run is all its
words). Documents of one set form a class, and only one of each class is compared. Each set has
``BANDS`` band hashes of ``ROWS`` MinHash values; at similarity 0.8 a pair shares a band with
probability 1 - (1 - 0.8**4)**16 = 0.9998. Documents are dealt out by band hash, bands with the
same members are one group, and a group of any size is cut into blocks of bounded size whose
pairs of blocks are separate work, so no task holds a whole hot group. A pair is verified on
the full sets in numpy, in exact integers, once: in the smallest group that holds both. What
leaves a block pair is a row for each document in it, its number of links and one edge to the
smallest document it hangs together with there; pairs are never rows.

Defined cases: a null or empty text, or one of white space only, has no set and links to
nothing; repeated rows and equal texts are copies of one class, each a link of the others; a null
document id is kept and orders before all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import apart, bounded_batches, in_arrow, text_or_empty
from orderlens.llm.components import components
from orderlens.llm.textbytes import joined, mix, ngrams, per_text_unique, seeds, slices, whole_groups, words
from orderlens.session import stage

NGRAM, BANDS, ROWS = 5, 16, 4
#: Similarity as a fraction, compared in integers.
NUMERATOR, DENOMINATOR = 4, 5
#: A block holds about this many sets, or bytes of text.
BLOCK_SETS, BLOCK_BYTES = 512, 2 << 20
#: Columns of the incidence matrix handled at once.
COLUMNS = 4096

_HASHES = seeds(BANDS * ROWS, 41)
_BAND = seeds(BANDS, 43)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def text_sets(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending, and their offsets."""
    hashes, _, _, bounds = words(data, offsets)
    return per_text_unique(*ngrams(hashes, bounds, n))


def band_hashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of band hashes for each set that isn't empty."""
    some = np.flatnonzero(np.diff(at))
    low = np.empty((len(some), BANDS * ROWS), np.uint64)
    for k, seed in enumerate(_HASHES):
        low[:, k] = np.minimum.reduceat(values * seed, at[some])  # the values are mixed already
    out = np.empty((len(some), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(some), _BAND[band])
        for k in range(ROWS):
            h = mix(h ^ low[:, band * ROWS + k])
        out[:, band] = h
    return out


def set_ids(values: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    return [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "_text"):
            data, offsets = joined(batch.column("_text"))
            values, at = text_sets(data, offsets)
            bands = band_hashes(values, at).view(np.int64)
            some = np.diff(at) > 0
            ends = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            nested = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1)), mask=pa.array(~some) if len(some) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(set_ids(values, at), pa.binary()), nested, pa.array(np.diff(offsets))],
                ["doc_id", "mark", "set_id", "bands", "size"],
            )


def with_set_id(df: DataFrame, column: str = "text") -> DataFrame:
    """All columns and ``_set_id``, null for a text without words."""
    from pyspark.sql.types import BinaryType, StructType

    schema = StructType([*df.schema.fields]).add("_set_id", BinaryType())
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                ids = set_ids(*text_sets(*joined(batch.column(column))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*names, "_set_id"])

    bounded_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def block_links(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each (group, block pair) in ``table``: row numbers, links of each row, smallest row it hangs together with."""
    data, offsets = joined(table.column("text"))
    values, at = text_sets(data, offsets)
    key = np.stack([table.column(c).to_numpy() for c in ("gid", "one", "two")])
    cuts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0)))
    side = table.column("block").to_numpy()
    copies = table.column("copies").to_numpy()
    gids = np.array(table.column("gids").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, BANDS)
    for a, b in zip(cuts, np.append(cuts[1:], len(side)), strict=True):
        n = b - a
        rows = np.arange(a, b)
        size = np.diff(at[a : b + 1])
        flat = values[at[a] : at[b]]
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(n), size)
        met = count[code] > 1  # values of one set alone can't be shared
        new = np.cumsum(count > 1) - 1
        code, of = new[code[met]], of[met]
        both = np.zeros((n, n), np.float32)
        order = np.argsort(code, kind="stable")
        code, of = code[order], of[order]
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
            i, j = np.searchsorted(code, (low, low + COLUMNS))
            part = np.zeros((n, min(COLUMNS, int(code[-1]) + 1 - low)), np.float32)
            part[of[i:j], code[i:j] - low] = 1
            both += part @ part.T  # counts below 2**24 are exact
        both = both.astype(np.int64)
        linked = DENOMINATOR * both >= NUMERATOR * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(linked, False)
        if key[1, a] != key[2, a]:
            linked &= side[a:b, None] != side[None, a:b]
        x, y = np.nonzero(linked)
        if not len(x):
            continue
        g = gids[a:b]
        same = g[x] == g[y]
        lowest = np.where(same & (g[x] != -1), g[x].view(np.uint64), _NONE).min(1)
        mine = lowest == np.uint64(np.int64(key[0, a]).view(np.uint64))
        x, y = x[mine], y[mine]
        if not len(x):
            continue
        links = np.bincount(x, copies[a:b][y], n).astype(np.int64)
        root = np.arange(n)
        while True:
            low = root.copy()
            np.minimum.at(low, x, root[y])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = links > 0
        yield rows[some], links[some], a + root[some]


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in whole_groups(batches, ["gid", "one", "two"], rows=4_000, size=12 << 20):
        ids = part.column("set_id").combine_chunks()
        for rows, links, roots in block_links(part):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(links), ids.take(pa.array(roots))], ["set_id", "links", "root"])


def classes(docs: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every document's set, and every set's class.

    First frame: doc_id, set_id (null without words). Second: set_id, keeper (smallest doc_id of
    the set), copies, root (smallest set_id of its near duplicates), links (other documents).
    """
    text = text_or_empty(column)
    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("_text"))
    made = in_arrow(marked, sketch, f"doc_id {kind}, mark long, set_id binary, bands array<long>, size long")
    made = stage(made, "sketches")
    members = made.select("doc_id", "set_id")
    sets = made.where("set_id is not null").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "mark")).alias("low"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.max("size").alias("size")
    )
    sets = stage(sets.select("set_id", F.col("low.doc_id").alias("keeper"), F.col("low.mark").alias("mark"), "copies", "bands", "size"), "sets")
    rows = sets.select("set_id", "size", F.posexplode("bands").alias("pos", "band"))
    groups = rows.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"),
        F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("s2"),
    ).where("n > 1")
    # bands of the same members are one group, named by one of them; read as unsigned, the smallest counts
    groups = stage(groups, "bands")
    unsigned = F.col("band").bitwiseXOR(F.lit(-(2**63)))
    named = groups.groupBy("s1", "s2", "n").agg(F.min(unsigned).bitwiseXOR(F.lit(-(2**63))).alias("gid"))
    groups = groups.join(named, ["s1", "s2", "n"]).select(
        "band", "gid", F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks")
    )
    held = rows.join(groups, "band").groupBy("set_id").agg(F.collect_list(F.struct("pos", "gid", "blocks")).alias("found"))
    by_pos = F.map_from_entries(F.transform("found", lambda x: F.struct(x["pos"], x["gid"])))
    held = held.select(
        "set_id",
        F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.coalesce(F.get(F.map_values(F.map_filter(by_pos, lambda p, g: p == k)), F.lit(0)), F.lit(-1).cast("long"))).alias("gids"),
        F.array_distinct(F.transform("found", lambda x: F.struct(x["gid"], x["blocks"]))).alias("own"),
    )
    held = stage(held.join(sets.select("set_id", "keeper", "mark", "copies"), "set_id"), "held")
    # a keeper is found by its id and its text: many texts may share an id, or have none
    keepers = held.select("set_id", "keeper", F.col("mark").alias("keeper_mark")).hint("shuffle_hash")
    texts = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.col(column).alias("text"))
    texts = texts.join(keepers, F.col("doc_id").eqNullSafe(F.col("keeper")) & (F.col("mark") == F.col("keeper_mark")))
    texts = with_set_id(texts.select("text", "set_id")).where(F.col("_set_id") == F.col("set_id")).select("set_id", "text")
    # the text of a set's keeper, once, should rows be repeated or ids be used twice
    twice = made.where("set_id is not null").groupBy("doc_id", "set_id").count().where("count > 1").limit(1).count()
    texts = texts.dropDuplicates(["set_id"]) if twice else texts
    dealt = held.join(texts, "set_id").select("set_id", "copies", "gids", "text", F.explode("own").alias("g"))
    dealt = dealt.select("set_id", "copies", "gids", "text", F.col("g.gid").alias("gid"), F.col("g.blocks").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(7), "set_id"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("gid", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "set_id", "copies", "gids", "text")
    dealt = dealt.repartition("gid", "one", "two").sortWithinPartitions("gid", "one", "two")
    bounded_batches(docs.sparkSession)
    found = stage(dealt.mapInArrow(verify, "set_id binary, links long, root binary"), "links")
    roots = components(found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    out = sets.select("set_id", "keeper", "copies").join(links, "set_id", "left").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    out = out.select("set_id", "keeper", "copies", F.coalesce("root", "set_id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return members, out


def near_duplicates(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, class_id (smallest document id of its near duplicates), copy_of (smallest id of
    its exact set), n_links (other documents of similarity 0.8 or more), for every document."""
    members, sets = classes(docs, column)
    lowest = sets.groupBy("root").agg(F.min(F.struct("keeper")).alias("low"))
    sets = sets.join(lowest, "root").select("set_id", F.col("low.keeper").alias("class_id"), F.col("keeper").alias("copy_of"), "links")
    out = members.join(sets, "set_id", "left")
    lone = F.col("set_id").isNull()
    return out.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, column: str = "text") -> DataFrame:
    """The documents without the near duplicates of one with a smaller id; one row of each group stays.

    Rows without words stay as they are.
    """
    _, sets = classes(docs, column)
    given = apart(docs, "doc_id", column)
    lowest = sets.groupBy("root").agg(F.min(F.struct("keeper", "set_id")).alias("low"))
    sets = stage(sets.join(lowest, "root").where((F.col("copies") > 1) | (F.col("low.set_id") != F.col("set_id")) | (F.col("links") > 0)).select(
        "set_id", (F.col("low.set_id") == F.col("set_id")).alias("stays"), "keeper"), "decisions")
    marked = with_set_id(given, column).join(sets.withColumnRenamed("set_id", "_set_id").withColumnRenamed("keeper", "_keeper").withColumnRenamed("stays", "_stays"), "_set_id", "left")
    alone = marked.where("_stays is null").select(*given.columns)
    first = marked.where(F.col("_stays") & F.col("doc_id").eqNullSafe(F.col("_keeper"))).dropDuplicates(["_set_id"]).select(*given.columns)
    return alone.unionByName(first).toDF(*docs.columns)
