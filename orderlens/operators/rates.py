"""Return rates by dimension, risk segments, product losses and the monthly trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.labels import month_label
from orderlens.functions.money import money, rate_pct
from orderlens.functions.rows import unpack
from orderlens.operators.enrich import fold_by_product, one_row_per_key, price_fold
from orderlens.operators.skew import fold


def _one() -> Column:
    return F.lit(1).cast("long")


def _returned() -> Column:
    return F.col("returned").cast("long")


def rates_by_columns(cells: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One rate table per column and one overall, stacked as ``(dimension, label, ...)``.

    ``cells`` has one row per combination of the columns with ``n`` and ``n_returned``, so
    the grouping sets expand a few combinations and not the orders. Rows without a label
    are left out of that label's table.
    """
    sets = cells.groupingSets([[d] for d in dims] + [[]], *dims).agg(
        F.sum("n").alias("orders"), F.sum("n_returned").alias("returned_orders"), F.grouping_id(*dims).alias("level")
    )
    everything = 2 ** len(dims) - 1
    dimension = F.when(F.col("level") == everything, "all")
    label = F.when(F.col("level") == everything, "all")
    for i, d in enumerate(dims):
        here = F.col("level") == everything - 2 ** (len(dims) - 1 - i)
        dimension, label = dimension.when(here, d), label.when(here, F.col(d))
    return sets.select(
        dimension.alias("dimension"),
        label.alias("label"),
        "orders",
        "returned_orders",
        rate_pct(F.col("returned_orders"), F.col("orders")).alias("return_rate_pct"),
    ).filter(F.col("label").isNotNull())


def rate_cells(orders: DataFrame, dims: Sequence[str]) -> DataFrame:
    return fold(orders, dims, n=_one(), n_returned=_returned())


def rates_by_dimension(
    orders: DataFrame, products: DataFrame, customers: DataFrame, lines: DataFrame | None = None
) -> DataFrame:
    """Orders and return rate per payment method, category, city and channel, and overall.

    Customers and payment methods are folded first and then joined, and so are products:
    no single order row is joined. ``lines`` are the same orders where they can be had with
    fewer columns: the product side needs product and return only.
    """
    per_customer = rate_cells(orders, ["customer_id", "payment_method"])
    attributes = one_row_per_key(customers.select("customer_id", "city", "acquisition_source"), "customer_id")
    dims = ["payment_method", "city", "acquisition_source"]
    cells = fold(
        per_customer.join(attributes, "customer_id", "left"), dims, n=F.col("n"), n_returned=F.col("n_returned")
    )
    per_product = rate_cells(orders if lines is None else lines, ["product_id"]).join(one_row_per_key(products.select("product_id", "category"), "product_id"), "product_id")
    by_category = rates_by_columns(
        fold(per_product, ["category"], n=F.col("n"), n_returned=F.col("n_returned")), ["category"]
    )
    return rates_by_columns(cells, dims).unionByName(by_category.filter(F.col("dimension") == "category"))


def risk_segments(orders: DataFrame, customers: DataFrame, payment_method: str | None = None) -> DataFrame:
    """Orders and return rate per payment method and city tier, worst first."""
    rows = orders if payment_method is None else orders.filter(F.col("payment_method") == payment_method)
    per_customer = rate_cells(rows, ["customer_id", "payment_method"])
    return rank_risk(per_customer.join(one_row_per_key(customers.select("customer_id", "city_tier"), "customer_id"), "customer_id", "left"))


def rank_risk(cells: DataFrame) -> DataFrame:
    return (
        cells.filter(F.col("payment_method").isNotNull() & F.col("city_tier").isNotNull())
        .groupBy("payment_method", "city_tier")
        .agg(
            F.sum("n").alias("orders"),
            rate_pct(F.sum("n_returned"), F.sum("n")).alias("return_rate_pct"),
        )
        .orderBy(F.desc("return_rate_pct"), "payment_method", "city_tier")
    )


def rating_contrast(orders: DataFrame) -> DataFrame:
    """Return rate of badly (1-2) and well (4-5) rated orders."""
    band = F.when(F.col("rating") <= 2, "rating 1-2").when(F.col("rating") >= 4, "rating 4-5")
    return (
        orders.filter((F.col("rating") <= 2) | (F.col("rating") >= 4))
        .groupBy(band.alias("band"))
        .agg(F.count(F.lit(1)).alias("orders"), rate_pct(F.sum(_returned()), F.count(F.lit(1)), 1).alias("return_rate_pct"))
        .orderBy("band")
    )


def worst_product(orders: DataFrame, products: DataFrame) -> DataFrame:
    """The product whose returned orders were worth the most; the smaller key wins a tie."""
    returned = orders.filter(F.col("returned") == 1)
    return _largest_loss(price_fold(fold_by_product(returned), products))


def _largest_loss(totals: DataFrame) -> DataFrame:
    return (
        totals.select("product_id", "product_name", money(F.col("amount")).alias("revenue_lost"))
        .orderBy(F.desc("revenue_lost"), "product_id")
        .limit(1)
    )


def returned_share(orders: DataFrame) -> DataFrame:
    """How many orders were returned and not returned, with their share of all orders."""
    counts = orders.groupBy("returned").agg(F.count(F.lit(1)).alias("orders"))
    total = counts.agg(F.sum("orders")).scalar()
    return counts.withColumn("pct", rate_pct(F.col("orders"), total, 1)).orderBy("returned")


def trend(valued: DataFrame, amount: str = "order_value", period: Column | None = None) -> DataFrame:
    """Totals per period with and without the flagged rows, and the return rate, in one pass."""
    label = month_label(F.col("order_date")) if period is None else period
    return (
        valued.groupBy(label.alias("month"))
        .agg(
            money(F.sum(amount)).alias("revenue_all_orders"),
            money(F.sum(F.when(~F.col("is_outlier"), F.col(amount)))).alias("revenue_without_outliers"),
            rate_pct(F.sum(_returned()), F.count(F.lit(1))).alias("return_rate_pct"),
        )
        .orderBy("month")
    )


def peak(trend_rows: DataFrame, amount: str, key: str = "month") -> DataFrame:
    """The period with the largest total; the earliest wins a tie."""
    return trend_rows.select(key, amount).orderBy(F.desc_nulls_last(amount), key).limit(1)


def best_period(amount: str, key: str = "month") -> Column:
    """Aggregate of trend rows: the period with the largest amount, the earliest of equals."""
    ranked = F.struct((-F.col(amount)).alias("order"), F.col(key).alias("month"), F.col(amount).alias("revenue"))
    best = F.min(F.when(F.col(amount).isNotNull(), ranked))
    return F.struct(best["month"].alias("month"), best["revenue"].alias("revenue"))


def peaks(trend_rows: DataFrame) -> DataFrame:
    """Peak period over all rows and over the rows without outliers, from one aggregate."""
    series = {"all orders": "revenue_all_orders", "outliers excluded": "revenue_without_outliers"}
    best = trend_rows.agg(*[best_period(amount).alias(amount) for amount in series.values()])
    cells = [
        F.struct(F.lit(name).alias("series"), F.col(f"{amount}.month").alias("month"), F.col(f"{amount}.revenue").alias("revenue"))
        for name, amount in series.items()
    ]
    return unpack(best, F.array(*cells))
