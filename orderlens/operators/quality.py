"""Data quality: the declared constraints as counts of violations and as reject routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens import schemas
from orderlens.functions.rows import unpack
from orderlens.operators.cleaning import count_copies
from orderlens.operators.skew import HotKeys, spread_join
from orderlens.schemas import DEDUP_KEY


class Check(NamedTuple):
    """A row constraint; ``failed`` is true for rows that break it."""

    name: str
    failed: Column


def not_null(columns: Sequence[str]) -> list[Check]:
    return [Check(f"{c} not null", F.col(c).isNull()) for c in columns]


def readable(line: str = "_corrupt") -> Check:
    """Lines of a CSV file with a cell that did not fit its type, as ``read_csv`` keeps them."""
    return Check("unreadable cell", F.col(line).isNotNull())


def in_domain(domains: Mapping[str, Sequence]) -> list[Check]:
    """A NULL passes, as in a SQL CHECK."""
    return [Check(f"{c} in domain", ~F.col(c).isin(*values)) for c, values in domains.items()]


def in_range(ranges: Mapping[str, tuple]) -> list[Check]:
    """``(low, high, low_allowed)`` per column; None leaves a side open and a NULL passes."""
    checks = []
    for c, (low, high, low_allowed) in ranges.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low if low_allowed else F.col(c) <= low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        checks.append(Check(f"{c} in range", bad))
    return checks


def declared_checks(table: str) -> list[Check]:
    """Every row constraint declared for one of the retail tables."""
    return [
        *not_null(schemas.NOT_NULL[table]),
        *in_domain(schemas.DOMAINS[table]),
        *in_range(schemas.RANGES[table]),
    ]


def _stacked(counts: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    """One row of counters ``c0, c1, ...`` as rows ``(label, value)``."""
    cells = [F.struct(F.lit(n).alias(label), F.col(f"c{i}").alias(value)) for i, n in enumerate(names)]
    return unpack(counts, F.array(*cells))


def count_violations(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """``(check_name, problems)`` for all checks, in one pass."""
    counts = df.agg(*[F.count_if(check.failed).alias(f"c{i}") for i, check in enumerate(checks)])
    return _stacked(counts, [check.name for check in checks], "check_name", "problems")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return count_violations(df, [Check(f"{c} NULLs", F.col(c).isNull()) for c in columns])


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows_loaded")).select(F.lit(name).alias("table_name"), "rows_loaded")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """How many keys occur more than once, and how many rows are surplus."""
    return (
        df.groupBy(*key)
        .count()
        .filter("count > 1")
        .agg(F.count(F.lit(1)).alias("problems"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus_rows"))
        .select(F.lit(name).alias("check_name"), "problems", "surplus_rows")
    )


def orphans(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, name: str) -> DataFrame:
    """Rows whose key is missing in the dimension; a NULL key passes.

    The fact is counted per key first: the anti join sees each key once, so a key with
    many rows is one row there.
    """
    per_key = fact.filter(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias("_key")).count()
    missing = per_key.join(dim.select(F.col(dim_key).alias("_key")), "_key", "left_anti")
    return missing.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("problems"), F.count(F.lit(1)).alias("orphan_keys")
    ).select(F.lit(name).alias("check_name"), "problems", "orphan_keys")


def join_row_count(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, name: str) -> DataFrame:
    """Rows before and after a left join to the dimension, computed from counts per key."""
    per_key = fact.groupBy(F.col(fact_key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    copies = dim.groupBy(F.col(dim_key).alias("_key")).agg(F.count(F.lit(1)).alias("m"))
    after = F.col("n") * F.greatest(F.coalesce("m", F.lit(0)), F.lit(1))
    return (
        per_key.join(copies, "_key", "left")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum(after), F.lit(0)).alias("rows_after"))
        .select(
            F.lit(name).alias("check_name"),
            "rows_before",
            "rows_after",
            (F.col("rows_before") == F.col("rows_after")).alias("preserved"),
        )
    )


def value_counts(df: DataFrame, column: str, label: str = "value", n: str = "n") -> DataFrame:
    """Frequency of each value that is present, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(label))
        .agg(F.count(F.lit(1)).alias(n))
        .orderBy(F.desc(n), label)
    )


def profile_orders(
    orders: DataFrame, key: Sequence[str] = DEDUP_KEY, label: str = "payment_method", large: int = 5
) -> DataFrame:
    """What is wrong with raw orders, as rows ``(metric, item, value)``.

    Each spelling of the label is a row of its own, however many there are.
    """
    counts = orders.agg(
        F.count(F.lit(1)).alias("c0"),
        F.count_if(F.col("discount_pct").isNull()).alias("c1"),
        F.count_if(F.col("rating").isNull()).alias("c2"),
        F.count_if(F.col("quantity").try_cast("double") > large).alias("c3"),
    )
    names = ["rows", "missing discount_pct", "missing rating", f"quantity above {large}"]
    none = F.lit(None).cast("string")
    simple = _stacked(counts, names, "metric", "value").select("metric", none.alias("item"), "value")
    copies = count_copies(orders, key).select(
        F.lit("duplicate rows").alias("metric"), none.alias("item"), F.col("copies").alias("value")
    )
    spellings = value_counts(orders, label, "item", "value")
    # Counting by the value keeps the shuffled rows equal to those of the list below, so
    # both read one shuffle.
    distinct = spellings.agg(F.count_if(F.col("value") > 0).alias("value")).select(
        F.lit(f"{label} spellings").alias("metric"), none.alias("item"), "value"
    )
    each = spellings.select(F.lit(f"{label} spelling").alias("metric"), "item", "value")
    return reduce(DataFrame.unionByName, [simple, copies, distinct, each])


def route(
    df: DataFrame,
    checks: Sequence[Check],
    references: Sequence[tuple[str, DataFrame, str, HotKeys | None]] = (),
    unique: tuple[str, str] | None = None,
) -> DataFrame:
    """Every row with ``reject_reasons``: the names of the failed checks, empty if none.

    ``references`` are foreign keys ``(column, dimension, key of the dimension, hot keys)``.
    Key copies in a dimension do not multiply rows. ``unique`` names a primary key and the
    column that tells which row came first: later rows of the same key are rejected.
    """
    reasons = [F.when(check.failed, check.name) for check in checks]
    added = []
    if unique:
        key, order_by = unique
        repeated = (
            df.groupBy(key)
            .agg(F.min(order_by).alias("_first"), F.count(F.lit(1)).alias("_n"))
            .filter("_n > 1")
            .drop("_n")
        )
        df = spread_join(df, repeated, key, "left")
        added.append("_first")
        reasons.append(F.when(F.col(order_by) > F.col("_first"), f"{key} repeated"))
    for i, (column, dim, key, hot) in enumerate(references):
        present = dim.select(F.col(key).alias(column)).distinct().withColumn(f"_found{i}", F.lit(True))
        df = spread_join(df, present, column, "left", hot)
        added.append(f"_found{i}")
        reasons.append(F.when(F.col(column).isNotNull() & F.col(f"_found{i}").isNull(), f"{column} unknown"))
    return df.withColumn("reject_reasons", F.array_compact(F.array(*reasons))).drop(*added)


def accepted(routed: DataFrame) -> DataFrame:
    return routed.filter(F.size("reject_reasons") == 0).drop("reject_reasons")


def rejected(routed: DataFrame) -> DataFrame:
    return routed.filter(F.size("reject_reasons") > 0)
