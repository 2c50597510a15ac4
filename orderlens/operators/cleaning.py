"""Cleaning: coerce, normalise labels, drop later copies, fill missing values.

The order matters. A blank and a zero discount are copies of one another only once
blanks are filled, so filling before or after the removal of copies gives other rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.coerce import to_number
from orderlens.functions.labels import clean_label
from orderlens.functions.money import money
from orderlens.operators.copies import BITS, by_repeats, row_identity
from orderlens.operators.quantiles import exact_quantiles
from orderlens.schemas import DEDUP_KEY
from orderlens.session import stage

ORDER_NUMBERS = {"quantity": "double", "discount_pct": "double", "rating": "double", "returned": "int"}


def coerce_numeric(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Read the named columns as numbers; what cannot be read becomes NULL."""
    return df.withColumns({name: to_number(F.col(name), to) for name, to in columns.items()})


def normalise_labels(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: clean_label(F.col(name)) for name in columns})


def keep_first(
    df: DataFrame,
    key: Sequence[str] = DEDUP_KEY,
    order_by: str = "order_id",
    count_as: str | None = None,
    sums: Mapping[str, Column] | None = None,
    bits: int = BITS,
) -> DataFrame:
    """One row per key, the one with the smallest ``order_by``; NULLs in the key are equal.

    Rows that are alone with their key pass as they are. Of the others only the columns of the
    key, ``order_by`` and a hash of the row are aggregated; the whole rows meet the chosen
    hashes in a hash join, behind which equal rows are folded. Rows that agree in key and ``order_by`` are told
    apart by the hash. ``count_as`` adds the number of rows each kept row stands for, ``sums``
    sums over those rows. ``df`` is read three times: where it is costly, ``fold_first`` reads
    it once.
    """
    alone, several = by_repeats(df, key, bits)
    extra = {count_as: F.lit(1).cast("long")} if count_as else {}
    extra |= dict(sums or {})
    totals = [F.sum(expr).alias(name) for name, expr in extra.items()]
    hashes = dict(zip(("_t", "_u"), row_identity(df.columns), strict=True))
    chosen = several.withColumns(hashes).groupBy(*key).agg(F.min(F.struct(order_by, *hashes)).alias("_first"), *totals)
    chosen = chosen.select("_first._t", "_first._u", *extra).hint("shuffle_hash")
    first = several.withColumns(hashes).join(chosen, ["_t", "_u"]).select(*df.columns, *extra).distinct()
    single = alone.withColumns({name: expr.cast(first.schema[name].dataType) for name, expr in extra.items()})
    return single.unionByName(first)


def fold_first(
    df: DataFrame,
    key: Sequence[str] = DEDUP_KEY,
    order_by: str = "order_id",
    count_as: str | None = None,
    sums: Mapping[str, Column] | None = None,
    by_hash: bool = False,
) -> DataFrame:
    """``keep_first`` in one pass over ``df``: whole rows are aggregated, which Spark sorts.

    Copies collapse before the shuffle, so a key with very many copies costs one row per task.
    Rows that agree in key and ``order_by`` are told apart by their other columns, or, ``by_hash``,
    as in ``keep_first``.
    """
    hashes = dict(zip(("_t", "_u"), row_identity(df.columns), strict=True)) if by_hash else {}
    rest = [*hashes, *(c for c in df.columns if c not in key and c != order_by)]
    counts = [F.count(F.lit(1)).alias(count_as)] if count_as else []
    totals = {name: F.sum(expr).alias(name) for name, expr in (sums or {}).items()}
    first = df.withColumns(hashes).groupBy(*key).agg(F.min(F.struct(order_by, *rest)).alias("_first"), *counts, *totals.values())
    extra = [*([count_as] if count_as else []), *totals]
    return first.select(*key, "_first.*", *extra).select(*df.columns, *extra)


def removed_copies(df: DataFrame, key: Sequence[str] = DEDUP_KEY, order_by: str = "order_id", bits: int = BITS) -> DataFrame:
    """The rows ``keep_first`` leaves out, for an ``order_by`` that is unique.

    Rows that are alone with their key are never removed and take no part. The join runs on
    ``order_by``, one row per value, not on the key of the copies.
    """
    _, several = by_repeats(df, key, bits)
    kept = several.groupBy(*key).agg(F.min(order_by).alias(order_by)).select(order_by)
    return several.join(kept.hint("shuffle_hash"), order_by, "left_anti")


def count_copies(df: DataFrame, key: Sequence[str] = DEDUP_KEY) -> DataFrame:
    """How many rows repeat an earlier key, as one row."""
    return df.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("copies"))


def fill_missing(df: DataFrame, rating_policy: str = "median", median: float | None = None) -> DataFrame:
    """Missing discounts become 0; missing ratings become the median or stay NULL."""
    filled = df.withColumn("discount_pct", F.coalesce("discount_pct", F.lit(0).cast(df.schema["discount_pct"].dataType)))
    if rating_policy == "keep_null":
        return filled
    if rating_policy != "median":
        raise ValueError(f"unknown rating policy: {rating_policy}")
    return fill_median(filled, "rating", median)


def fill_median(df: DataFrame, column: str, median: float | None = None) -> DataFrame:
    """Replace NULL by the exact median of the column."""
    if median is None:
        (median,) = exact_quantiles(df, column, [0.5])
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(median).cast("double")))


def clean_orders(
    orders: DataFrame,
    key: Sequence[str] = DEDUP_KEY,
    rating_policy: str = "median",
    date_format: str = "yyyy-MM-dd",
) -> DataFrame:
    """Coerce, normalise, drop copies, fill - in this order.

    The rows without copies are written once: the median and the result both read them. Text is
    read as numbers and dates once per row, so copies go in one pass.
    """
    unique = fold_first(typed_orders(orders, date_format), key, by_hash=True)
    if rating_policy == "median":
        unique = stage(unique, "clean-orders")
    return fill_missing(unique, rating_policy)


def clean_orders_fill_first(
    orders: DataFrame, key: Sequence[str] = DEDUP_KEY, date_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """The variant of the charts: discounts are filled before copies are dropped."""
    return fold_first(fill_missing(typed_orders(orders, date_format), "keep_null"), key, by_hash=True)


def typed_orders(orders: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Numbers, dates and labels; an unreadable date is an error."""
    text = {f.name for f in orders.schema.fields if f.dataType.typeName() == "string"}
    typed = coerce_numeric(orders, {c: to for c, to in ORDER_NUMBERS.items() if c in text})
    if "order_date" in text:
        typed = typed.withColumn("order_date", F.to_date("order_date", date_format))
    return normalise_labels(typed, "payment_method")


def reconcile(
    orders: DataFrame, amount: str, key: Sequence[str] = DEDUP_KEY, order_by: str = "order_id"
) -> DataFrame:
    """Raw against clean totals of ``amount``, in one pass over the rows.

    Each key yields its total and the amount of its first row; the difference is what the
    removed copies were worth.
    """
    return reconcile_state(copy_state(orders, amount, key, order_by))


def copy_state(orders: DataFrame, amount: str, key: Sequence[str] = DEDUP_KEY, order_by: str = "order_id") -> DataFrame:
    """What is known of each key: rows ``n``, their ``total`` and the ``first`` row (id and amount).

    Kept as a table, it stands for all rows so far: ``merge_state`` takes in later ones, copies
    of old keys and rows with smaller ids included, and reads no old row again.
    """
    first = F.struct(F.col(order_by).alias("id"), F.col(amount).alias("amount"))
    return orders.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"), F.min(first).alias("first"))


def merge_state(state: DataFrame, later: DataFrame) -> DataFrame:
    """The state of all rows from that of the old ones and that of a later batch."""
    kind = state.schema["total"].dataType
    key = [c for c in state.columns if c not in ("n", "total", "first")]
    both = state.unionByName(later.withColumn("total", F.col("total").cast(kind)))
    return both.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("total").cast(kind).alias("total"), F.min("first").alias("first"))


def reconcile_state(state: DataFrame) -> DataFrame:
    """Raw against clean totals of the rows behind a state."""
    kept = F.coalesce(F.col("first.amount"), F.lit(0))
    return state.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_rows"),
        F.count(F.lit(1)).alias("clean_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed_rows"),
        F.coalesce(money(F.sum("total")), F.lit(0.0)).alias("raw_total"),
        F.coalesce(money(F.sum("first.amount")), F.lit(0.0)).alias("clean_total"),
        F.coalesce(money(F.sum(F.col("total") - kept)), F.lit(0.0)).alias("delta"),
    )
