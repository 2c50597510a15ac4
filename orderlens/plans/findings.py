"""The findings: every figure of the clean analysis, as a document of fixed fields and side tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.labels import SPEND_TIERS, spend_tier
from orderlens.functions.leaves import numeric_leaves
from orderlens.functions.money import mean_money, money, net_units, priced, rate_pct
from orderlens.functions.rows import unpack
from orderlens.operators.cleaning import fill_missing, fold_first, typed_orders
from orderlens.operators.correlation import merged_r, moments
from orderlens.operators.enrich import enrich_orders
from orderlens.operators.outliers import Fences, fences_of, flag_outliers
from orderlens.operators.quantiles import quantiles_of
from orderlens.operators.rates import best_period, rank_risk, rates_by_columns
from orderlens.operators.segments import customer_rollup
from orderlens.operators.skew import HotKeys, hot_keys
from orderlens.schemas import DEDUP_KEY, FINDINGS
from orderlens.session import stage

DIMENSIONS = ("payment_method", "category", "city", "acquisition_source")
KEPT_COLUMNS = (
    "order_id",
    "customer_id",
    "product_id",
    "product_name",
    "order_date",
    "month",
    "quantity",
    "discount_pct",
    "rating",
    "returned",
    "order_value",
    "city_tier",
    "n_copies",
    "copies_value",
    *DIMENSIONS,
)

# The remark on the correlations.
WEAK_NOTE = "all correlations are weak (|r| < 0.15) - no single numeric variable explains returns"
NOTABLE_NOTE = "at least one correlation is not weak (|r| >= 0.15)"

# Partitions for each shuffle partition when copies are sorted out, so that a sort fits a task's memory,
# and rows from which products are hashed instead of sorted with the orders.
PIECES, MANY_PRODUCTS = 4, 200_000

# How outliers are found and treated.
METHOD, HANDLING = "IQR (1.5x)", "flagged only, never dropped"

# The side tables of the document: rates per label, revenue per month, ids of flagged orders.
MONTHLY, FLAGGED = "monthly", "outliers.order_ids"
TABLES = (*(f"returns.by_{d}" for d in DIMENSIONS), MONTHLY, FLAGGED)
CELLS = (*DIMENSIONS, "city_tier", "month", "is_outlier")
# The columns whose correlation with the last one is reported.
MEASURED = ("quantity", "discount_pct", "rating", "returned")
WITH_RETURNED = tuple((i, 3) for i in range(3))


class Analysis(NamedTuple):
    """Clean, enriched and flagged orders, their sums per cell of labels, and the fences behind the flags."""

    orders: DataFrame
    cells: DataFrame
    fences: Fences


def analyse(
    raw_orders: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    key: Sequence[str] = DEDUP_KEY,
    hot_products: HotKeys | None = None,
    hot_customers: HotKeys | None = None,
) -> Analysis:
    """Clean, join and value the orders once and write the result to the shared folder.

    Everything below reads that copy, each part only the columns it needs. Copies may differ
    in all but ``key``; what they are worth is summed before they go, at the price of their
    product, so the product has to be in the key. Where the customer is in it too and none is hot,
    the orders are shuffled by customer once and sorted once, for the copies and for the join. Many
    products are hashed, as a sort of all orders would spill.
    """
    if "product_id" not in key:
        raise ValueError("the key of copies must hold product_id, which sets their price")
    typed = typed_orders(raw_orders)
    if "customer_id" in key:
        hot_customers = hot_keys(typed, "customer_id") if hot_customers is None else hot_customers
        if not hot_customers.values and not hot_customers.null_share:
            key = ("customer_id", *(c for c in key if c != "customer_id"))
            partitions = int(typed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            typed = typed.repartition(PIECES * partitions, "customer_id")
    unique = fold_first(typed, key, count_as="n_copies", sums={"net_of_all": net_units(typed)})
    if products.count() > MANY_PRODUCTS:
        products = products.hint("shuffle_hash")
    enriched = enrich_orders(unique, products, customers, hot_products, hot_customers)
    enriched = enriched.withColumn("copies_value", priced(F.col("net_of_all") - net_units(enriched), F.col("price")))
    stored = stage(enriched.select(*KEPT_COLUMNS), "enriched-orders")
    known = quantiles_of(stored, {"quantity": [0.25, 0.75], "rating": [0.5]})
    fences = fences_of(*known["quantity"])
    orders = flag_outliers(fill_missing(stored, median=known["rating"][0]), "quantity", fences)
    return Analysis(orders, stage(fold_cells(orders), "cells"), fences)


def fold_cells(orders: DataFrame) -> DataFrame:
    """Sums per combination of labels, tier, month and flag: what most figures are made of."""
    return orders.groupBy(*CELLS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_copies").alias("n_raw"),
        F.sum(F.col("returned").cast("long")).alias("n_returned"),
        F.sum("order_value").alias("amount"),
        F.sum("copies_value").alias("surplus"),
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
        *moments(MEASURED, WITH_RETURNED),
    )


def monthly_of(cells: DataFrame) -> DataFrame:
    """Revenue per month with and without the flagged rows; NULL where all rows are flagged."""
    return cells.groupBy("month").agg(
        money(F.sum("amount")).alias("revenue_all_orders"),
        money(F.sum(F.when(~F.col("is_outlier"), F.col("amount")))).alias("revenue_without_outliers"),
    )


def findings_tables(analysis: Analysis) -> DataFrame:
    """The side tables of the document as rows ``(section, label, metric, value)``, whatever their size.

    Flagged orders are rows without metric and value.
    """
    rates = rates_by_columns(analysis.cells, DIMENSIONS).filter(F.col("dimension") != "all")
    cell = lambda metric: F.struct(F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"))
    rates = unpack(
        rates.withColumn("section", F.concat(F.lit("returns.by_"), "dimension")),
        F.array(cell("orders"), cell("return_rate_pct")),
        "section",
        "label",
    )
    none = F.lit(None)
    months = monthly_of(analysis.cells).filter("month IS NOT NULL AND revenue_without_outliers IS NOT NULL")
    months = months.select(
        F.lit(MONTHLY).alias("section"),
        F.col("month").alias("label"),
        none.cast("string").alias("metric"),
        F.col("revenue_without_outliers").alias("value"),
    )
    flagged = analysis.orders.filter("is_outlier").select(
        F.lit(FLAGGED).alias("section"),
        F.col("order_id").cast("string").alias("label"),
        none.cast("string").alias("metric"),
        none.cast("double").alias("value"),
    )
    return rates.unionByName(months).unionByName(flagged)


def figures(analysis: Analysis, document: DataFrame) -> DataFrame:
    """All numbers of the document and of its side tables, as ``(path, value)``."""
    rows = findings_tables(analysis).filter(F.col("value").isNotNull())
    return numeric_leaves(document).unionByName(rows.select(F.concat_ws(".", "section", "label", "metric").alias("path"), "value"))


def findings_document(
    analysis: Analysis, source_files: Sequence[str] = (), tiers: Sequence[float] = (1200, 2500)
) -> DataFrame:
    """The findings as one nested row of fixed fields; ``tables`` names what ``findings_tables`` holds."""
    orders, cells = analysis.orders, analysis.cells
    r = [merged_r(i, j).alias(MEASURED[i]) for i, j in WITH_RETURNED]
    tier = spend_tier(F.col("amount"), tiers)
    totals = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum("n_raw").alias("n_raw"),
        F.sum("n_returned").alias("n_returned"),
        F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"),
        F.coalesce(F.sum("surplus"), F.lit(0)).alias("surplus"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.coalesce(F.sum(F.when(F.col("is_outlier"), F.col("n"))), F.lit(0)).alias("flagged"),
    )
    by_month = monthly_of(cells).agg(
        best_period("revenue_all_orders").alias("peak_all"),
        best_period("revenue_without_outliers").alias("peak_kept"),
    )
    # One-row parts, each evaluated once and read by several fields below.
    parts = totals.withColumns(
        {
            "products": _row(_products(orders)),
            "risk": _row(rank_risk(cells).limit(1)),
            "months": _row(by_month),
            "r": _row(cells.agg(*r).withColumn("strongest", F.greatest(*[F.abs(MEASURED[i]) for i, _ in WITH_RETURNED]))),
            "people": _row(
                customer_rollup(orders).agg(
                    F.count(F.lit(1)).alias("all"), *[F.count_if(tier == t).alias(t) for t in SPEND_TIERS]
                )
            ),
        }
    )
    n = F.col("n")
    fences = analysis.fences
    document = parts.select(
        F.struct(
            F.array(*[F.lit(f) for f in source_files]).cast("array<string>").alias("source_files"),
            F.col("n_raw").alias("raw_orders"),
            n.alias("clean_orders"),
            (F.col("n_raw") - n).alias("duplicates_removed"),
            F.col("people.all").alias("customers"),
            F.col("products.n").alias("products"),
            F.struct(_iso("first").alias("from"), _iso("last").alias("to")).alias("period"),
        ).alias("data"),
        F.struct(
            money(F.col("amount") + F.col("surplus")).alias("raw_total_inr"),
            money(F.col("amount")).alias("clean_total_inr"),
            money(F.col("surplus")).alias("duplicate_delta_inr"),
            mean_money(F.col("amount"), n).alias("avg_order_value_inr"),
        ).alias("revenue"),
        F.struct(
            rate_pct(F.col("n_returned"), n).alias("overall_rate_pct"),
            F.col("n_returned").alias("returned_orders"),
            F.struct(
                F.col("products.worst.product_id").cast("string").alias("product_id"),
                F.col("products.worst.product_name").alias("product_name"),
                F.col("products.worst.revenue_lost").alias("revenue_lost_inr"),
            ).alias("worst_product_by_revenue_lost"),
        ).alias("returns"),
        F.col("risk").alias("highest_risk_segment"),
        F.struct(
            F.lit(METHOD).alias("method"),
            F.lit(fences.q1).cast("double").alias("q1"),
            F.lit(fences.q3).cast("double").alias("q3"),
            F.lit(fences.upper).cast("double").alias("upper_fence"),
            F.col("flagged").alias("flagged_rows"),
            F.lit(HANDLING).alias("handling"),
            F.col("months.peak_all").alias("peak_month_all_orders"),
            F.col("months.peak_kept").alias("peak_month_without_outliers"),
        ).alias("outliers"),
        F.struct(
            F.col("r.discount_pct").alias("discount_vs_returned"),
            F.col("r.rating").alias("rating_vs_returned"),
            F.col("r.quantity").alias("quantity_vs_returned"),
            F.when(F.col("r.strongest") < 0.15, WEAK_NOTE).otherwise(NOTABLE_NOTE).alias("note"),
        ).alias("correlations"),
        F.struct(
            *[F.col("people")[t].alias(f"{t.split()[0].lower()}_value_customers") for t in SPEND_TIERS]
        ).alias("segment_summary"),
        F.array(*[F.lit(t) for t in TABLES]).alias("tables"),
    )
    return document.select(*[F.col(f.name).cast(f.dataType) for f in FINDINGS.fields])


def _products(orders: DataFrame) -> DataFrame:
    """How many products were ordered, and the one whose returned orders were worth the most."""
    per_product = orders.groupBy("product_id", "product_name").agg(
        money(F.sum(F.when(F.col("returned") == 1, F.col("order_value")))).alias("lost")
    )
    known = F.col("lost").isNotNull() & F.col("product_name").isNotNull()
    worst = F.min(F.when(known, F.struct((-F.col("lost")).alias("order"), "product_id", "product_name", F.col("lost").alias("revenue_lost"))))
    return per_product.agg(F.count("product_id").alias("n"), worst.alias("worst"))


def _row(df: DataFrame) -> Column:
    """A one-row frame as a struct value."""
    return df.select(F.struct(*df.columns)).scalar()


def _iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")
