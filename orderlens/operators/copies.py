"""Rows that share a key: which may, found by a bit table, so that all others are left alone.

A grouped count of the hash of the key finds the keys that repeat. Their hashes set bits in a
table of fixed size, a scalar of the plan. A row whose bit is not set is the only one of its
key: it is neither sorted nor shuffled. Rows whose bit is set (copies, and a few that share a
bit by chance) take the longer way. The more keys repeat, the more rows take it; the result
is the same for every size of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the number of bits: 512 KB. Sixteen times the keys that repeat is a good size.
BITS = 22
_SLOT = "_key_slot"


def _slot(key: Sequence[str], bits: int) -> Column:
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << bits) - 1))


def repeated_bits(df: DataFrame, key: Sequence[str], bits: int = BITS) -> Column:
    """The bit table of the keys that repeat, as an array of 64-bit words."""
    hashes = df.select(F.xxhash64(*key).alias("h")).groupBy("h").count().where("count > 1")
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    set_bits = hashes.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    words = set_bits.select("word", F.expr("shiftleft(1L, at)").alias("bits"))
    empty = df.sparkSession.range(1 << max(bits - 6, 0)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = words.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return words.agg(in_order["bits"]).scalar()


def by_repeats(df: DataFrame, key: Sequence[str], bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Rows that are alone with their key, and all others (with a few that are alone too).

    ``df`` is read three times and has to give the same rows each time.
    """
    table = repeated_bits(df, key, bits)
    slotted = df.withColumn(_SLOT, _slot(key, bits))
    word = F.get(table, F.shiftright(_SLOT, 6).cast("int"))
    marked = F.call_function("shiftright", word, F.col(_SLOT).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return slotted.where(~marked).drop(_SLOT), slotted.where(marked).drop(_SLOT)


def row_identity(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row; a NULL counts as a value of its own place."""
    parts = [*columns, *(F.col(c).isNull() for c in columns)]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]
