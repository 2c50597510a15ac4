"""Joins and aggregates that stay balanced when one key holds a large share of the rows.

Two tools cover every plan in this package:

* ``fold``: aggregate the additive measures to the join key first. The map side collapses
  a hot key before anything is shuffled, and the following join sees each key once.
* ``spread_join``: where single rows must be joined, rows of a hot key are spread over
  several salts and only the few matching dimension rows are repeated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


class HotKeys(NamedTuple):
    """Keys that fill more than a partition, and the share of all rows that each one holds."""

    values: tuple = ()
    shares: tuple[float, ...] = ()
    null_share: float = 0.0


NO_HOT_KEYS = HotKeys()


def hot_keys(
    df: DataFrame, key: str, share: float | None = None, min_rows: int = 100_000, tracked: int = 1 << 16
) -> HotKeys:
    """Find the keys with more than ``share`` of all rows by one pass with a bounded sketch.

    By default that is the share of an average shuffle partition. Keys with at most
    ``min_rows`` rows fit any task and stay as they are. At most ``1 / share`` keys come to
    the driver. The list only decides which rows are spread, so a stale or incomplete list
    costs balance and never changes a result.
    """
    if share is None:
        share = 1 / max(2, _partitions(df))
    most = min(math.ceil(1 / share), tracked)
    found, present, total = df.agg(
        F.expr(f"approx_top_k(`{key}`, {most}, {tracked})"), F.count(key), F.count(F.lit(1))
    ).first()
    limit = max(share * total, min_rows)
    heavy = {r["item"]: r["count"] / total for r in found or () if r["item"] is not None and r["count"] > limit}
    nulls = (total - present) / total if total - present > limit else 0.0
    return HotKeys(tuple(heavy), tuple(heavy.values()), nulls)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fold(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """Sum the given expressions per key; the partial sums happen before the shuffle."""
    return df.groupBy(*keys).agg(*[F.sum(expr).alias(name) for name, expr in sums.items()])


def salt_count(df: DataFrame, share: float) -> int:
    """Enough salts that one piece of a key with this share is about one average partition."""
    return max(2, math.ceil(share * _partitions(df)))


def _salts(df: DataFrame, key: str, hot: HotKeys) -> Column:
    """How many salts the key of a row has: 1 unless it is hot."""
    one = F.lit(1).cast("long")
    counts = F.when(F.col(key).isNull(), F.lit(salt_count(df, hot.null_share)).cast("long"))
    if not hot.values:
        return counts.otherwise(one)
    kind = df.schema[key].dataType
    known = F.map_from_arrays(
        F.array(*[F.lit(v).cast(kind) for v in hot.values]),
        F.array(*[F.lit(salt_count(df, x)).cast("long") for x in hot.shares]),
    )
    return counts.otherwise(F.coalesce(F.try_element_at(known, F.col(key)), one))


def spread_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "inner",
    hot: HotKeys | None = None,
    spread_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join ``fact`` to ``dim`` on ``key``, spreading the rows of hot keys.

    Without hot keys this is a plain equi join whose strategy Spark picks from the sizes.
    ``how`` may be inner, left, left_semi or left_anti. The salt is a function of the
    row and of its input partition, so a task that runs again yields the same salts, and
    exact copies of one row spread as well. ``spread_by`` names the columns that go into
    the salt; the default is every other column of ``fact``.
    """
    if hot is None:
        hot = hot_keys(fact, key)
    if not hot.values and not hot.null_share:
        return fact.join(dim, key, how)
    columns = spread_by or [c for c in fact.columns if c != key]
    drawn = F.pmod(F.xxhash64(F.spark_partition_id(), *columns), _salts(fact, key, hot))
    every = F.sequence(F.lit(0).cast("long"), _salts(dim, key, hot) - 1)
    repeated = dim.filter(F.col(key).isNotNull()).withColumn(SALT, F.explode(every))
    return fact.withColumn(SALT, drawn).join(repeated, [key, SALT], how).drop(SALT)
