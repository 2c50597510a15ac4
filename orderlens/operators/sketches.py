"""Distinct counts and quantiles that merge: sketches kept in cells, read at any coarser grain.

A cell holds sketches of bounded size of its rows. Merging the cells of a coarser grain gives
the sketch of all their rows, so one fold over the orders answers for months, methods and the whole,
and new rows only add cells. Counts and quantiles are estimates with a stated error; where
exact ones are wanted, count one folded row per value, or use ``quantiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct sketch; k of a quantile sketch.
REGISTERS, K = 14, 2000
#: Four standard errors of a merged distinct sketch (1.04 / sqrt of the registers), relative.
DISTINCT_ERROR = 4 * 1.04 / 2 ** (REGISTERS / 2)
#: Rank error of a quantile sketch, as a share of the rows: about 0.15 % at this k for 99 % of the sketches; four times that.
RANK_ERROR = 0.006


def distinct_cells(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row for each combination of ``keys`` with ``n`` rows and the sketch ``distinct``; NULLs aren't counted."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(column, REGISTERS).alias("distinct"))


def distinct_of(cells: DataFrame, *keys: str) -> DataFrame:
    """``n`` and the estimated number of distinct values for a coarser grain of cells."""
    return cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("estimate"))


def quantile_cells(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """One row for each combination of ``keys`` with the number of values and their sketch; NULL and NaN are left out."""
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.count(value).alias("n_values"), F.kll_sketch_agg_double(value, K).alias("sketch"))


def quantiles_of_cells(cells: DataFrame, probabilities: Sequence[float], *keys: str) -> DataFrame:
    """Estimated quantiles for a coarser grain of cells, as rows (keys, p, estimate, n_values)."""
    merged = cells.where("n_values > 0").groupBy(*keys).agg(F.sum("n_values").alias("n_values"), F.kll_merge_agg_double("sketch", K).alias("sketch"))
    estimates = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(p)) for p in probabilities]))
    each = F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probabilities]).alias("p"), estimates.alias("estimate")))
    return merged.select(*keys, "n_values", each.alias("_e")).select(*keys, F.col("_e.p").alias("p"), F.col("_e.estimate").alias("estimate"), "n_values")


def within(estimate: Column, exact: Column, error: float = DISTINCT_ERROR) -> Column:
    """Whether an estimated count is within its error of the exact one."""
    return F.abs(estimate - exact) <= F.ceil(exact * F.lit(error))


def rank_within(p: Column, below: Column, upto: Column, n: Column, error: float = RANK_ERROR) -> Column:
    """Whether an estimated quantile has a rank near p: ``below`` rows are smaller, ``upto`` not larger."""
    slack = F.ceil(n * F.lit(error)) + 1
    return (below <= p * n + slack) & (upto >= p * n - slack)
