"""Outliers by the interquartile range: rows are flagged, never removed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.operators.quantiles import exact_quantiles, grouped_quantiles


class Fences(NamedTuple):
    q1: float | None
    q3: float | None
    lower: float | None
    upper: float | None


def iqr_fences(df: DataFrame, column: str, factor: float = 1.5) -> Fences:
    return fences_of(*exact_quantiles(df, column, [0.25, 0.75]), factor)


def fences_of(q1: float | None, q3: float | None, factor: float = 1.5) -> Fences:
    if q1 is None or q3 is None:
        return Fences(None, None, None, None)
    return Fences(q1, q3, q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))


def outside(column: str, fences: Fences) -> Column:
    """True outside the fences; a missing value is not an outlier."""
    value = F.col(column).cast("double")
    return F.coalesce((value < F.lit(fences.lower)) | (value > F.lit(fences.upper)), F.lit(False))


def flag_outliers(df: DataFrame, column: str, fences: Fences | None = None) -> DataFrame:
    return df.withColumn("is_outlier", outside(column, fences or iqr_fences(df, column)))


def outlier_rows(df: DataFrame, column: str, fences: Fences | None = None) -> DataFrame:
    return df.filter(outside(column, fences or iqr_fences(df, column)))


def iqr_summary(df: DataFrame, column: str, fences: Fences | None = None) -> DataFrame:
    """Quartiles, fences and the number of flagged rows."""
    fences = fences or iqr_fences(df, column)
    return df.agg(
        F.count(column).alias("n_values"),
        F.coalesce(F.count_if(outside(column, fences)), F.lit(0)).alias("flagged_rows"),
    ).select(
        *[
            F.round(F.lit(x).cast("double"), 6).alias(name)
            for name, x in (
                ("q1", fences.q1),
                ("q3", fences.q3),
                ("iqr", None if fences.q1 is None else fences.q3 - fences.q1),
                ("lower_fence", fences.lower),
                ("upper_fence", fences.upper),
            )
        ],
        "n_values",
        "flagged_rows",
    )


def group_fences(df: DataFrame, keys: Sequence[str], column: str, factor: float = 1.5) -> DataFrame:
    """Quartiles and fences of each group, from exact quantiles of all groups at once."""
    found = grouped_quantiles(df, keys, column, [0.25, 0.75])
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    return found.select(
        *keys,
        "n_values",
        q1.alias("q1"),
        q3.alias("q3"),
        (q1 - factor * (q3 - q1)).alias("lower_fence"),
        (q3 + factor * (q3 - q1)).alias("upper_fence"),
    )


def flag_by_group(df: DataFrame, keys: Sequence[str], column: str, fences: DataFrame | None = None) -> DataFrame:
    """Every row, flagged if it lies outside the fences of its own group; NULL keys are a group."""
    known = (fences or group_fences(df, keys, column)).select(*[F.col(k).alias(f"_{k}") for k in keys], "lower_fence", "upper_fence")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    value = F.col(column).cast("double")
    flag = F.coalesce((value < F.col("lower_fence")) | (value > F.col("upper_fence")), F.lit(False))
    return df.join(known, same, "left").select(*df.columns, flag.alias("is_outlier"))
