"""The nine business reports on raw orders.

Joins are inner, missing discounts count as zero and money is rounded to two digits.
Every sort ends with the key of the row, so equal values have one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.labels import discount_bucket, month_label, upper_trim
from orderlens.functions.money import mean_money, money, rate_pct
from orderlens.operators.enrich import fold_by_customer, fold_by_product, one_row_per_key, order_value, price_fold
from orderlens.operators.skew import HotKeys, fold


def _n() -> Column:
    return F.sum("n")


def _returned() -> Column:
    return F.sum("n_returned")


def _amount() -> Column:
    return F.sum("amount")


def _rate() -> Column:
    return rate_pct(_returned(), _n())


def headline(orders: DataFrame, products: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Report 1: totals over all orders. One row per customer makes the distinct count free."""
    per_customer = fold_by_customer(order_value(orders, products, hot))
    return per_customer.agg(
        F.coalesce(_n(), F.lit(0)).alias("total_orders"),
        F.count("customer_id").alias("customers"),
        money(_amount()).alias("total_revenue"),
        mean_money(_amount(), _n()).alias("avg_order_value"),
        _returned().alias("returned_orders"),
        _rate().alias("return_rate_pct"),
    )


def returns_by_category(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Report 2."""
    return (
        price_fold(fold_by_product(orders), products)
        .groupBy("category")
        .agg(
            _n().alias("total_orders"),
            _returned().alias("returned_orders"),
            _rate().alias("return_rate_pct"),
            money(_amount()).alias("revenue"),
        )
        .orderBy(F.desc("return_rate_pct"), "category")
    )


def value_by_payment(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Report 3: spellings that differ by case or outer blanks are one method."""
    labelled = orders.withColumn("payment_method", upper_trim(F.col("payment_method")))
    return (
        price_fold(fold_by_product(labelled, "payment_method"), products)
        .groupBy("payment_method")
        .agg(
            _n().alias("total_orders"),
            mean_money(_amount(), _n()).alias("avg_order_value"),
            money(_amount()).alias("revenue"),
            _rate().alias("return_rate_pct"),
        )
        .orderBy(F.desc("avg_order_value"), "payment_method")
    )


def top_returning_customers(
    orders: DataFrame, customers: DataFrame, min_orders: int = 3, top: int = 10
) -> DataFrame:
    """Report 4: highest return rates among customers with enough orders."""
    per_customer = fold(
        orders, ["customer_id"], total_orders=F.lit(1).cast("long"), returned_orders=F.col("returned").cast("long")
    ).filter(F.col("total_orders") >= min_orders)
    return (
        per_customer.join(one_row_per_key(customers, "customer_id"), "customer_id")
        .select(
            "customer_id",
            "name",
            "city",
            "acquisition_source",
            "total_orders",
            "returned_orders",
            rate_pct(F.col("returned_orders"), F.col("total_orders")).alias("return_rate_pct"),
        )
        .orderBy(F.desc("return_rate_pct"), F.desc("total_orders"), "customer_id")
        .limit(top)
    )


def _by_customer_attribute(
    orders: DataFrame, products: DataFrame, customers: DataFrame, attribute: str, hot: HotKeys | None
) -> DataFrame:
    """Customer totals joined to the customers; each group counts its rows as customers."""
    totals = fold_by_customer(order_value(orders, products, hot))
    return totals.join(one_row_per_key(customers.select("customer_id", attribute), "customer_id"), "customer_id").groupBy(attribute)


def city_performance(
    orders: DataFrame, products: DataFrame, customers: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Report 5."""
    return (
        _by_customer_attribute(orders, products, customers, "city", hot)
        .agg(
            F.count("customer_id").alias("customers"),
            _n().alias("total_orders"),
            money(_amount()).alias("revenue"),
            _rate().alias("return_rate_pct"),
        )
        .orderBy(F.desc("revenue"), "city")
    )


def channel_roi(
    orders: DataFrame, products: DataFrame, customers: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Report 6: revenue per customer of each acquisition channel."""
    n_customers = F.count("customer_id")
    return (
        _by_customer_attribute(orders, products, customers, "acquisition_source", hot)
        .agg(
            _n().alias("total_orders"),
            n_customers.alias("customers"),
            money(_amount()).alias("revenue"),
            mean_money(_amount(), n_customers).alias("revenue_per_customer"),
            _rate().alias("return_rate_pct"),
        )
        .orderBy(F.desc("revenue"), "acquisition_source")
    )


def product_loss(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Report 7: return rate and revenue lost to returns, per product."""
    return (
        price_fold(fold_by_product(orders), products)
        .select(
            "product_id",
            "product_name",
            "category",
            F.col("price").cast("double").alias("price"),
            F.col("n").alias("total_orders"),
            F.col("n_returned").alias("returned_orders"),
            rate_pct(F.col("n_returned"), F.col("n")).alias("return_rate_pct"),
            money(F.col("amount_returned")).alias("revenue_lost_to_returns"),
        )
        .orderBy(F.desc("return_rate_pct"), F.desc("revenue_lost_to_returns"), "product_id")
    )


def returns_by_discount(
    orders: DataFrame, products: DataFrame, low: int = 10, medium: int = 20
) -> DataFrame:
    """Report 8: return rate per discount bucket."""
    bucketed = orders.withColumn("discount_bucket", discount_bucket(F.col("discount_pct"), low, medium))
    return (
        price_fold(fold_by_product(bucketed, "discount_bucket"), products)
        .groupBy("discount_bucket")
        .agg(
            _n().alias("total_orders"),
            _returned().alias("returned_orders"),
            _rate().alias("return_rate_pct"),
            mean_money(_amount(), _n()).alias("avg_order_value"),
        )
        .orderBy("discount_bucket")
    )


def monthly_trend(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Report 9. Orders of a table written by month bring ``order_month`` with them, so filters on it prune files."""
    dated = orders if "order_month" in orders.columns else orders.withColumn("order_month", month_label(F.col("order_date")))
    return (
        price_fold(fold_by_product(dated, "order_month"), products)
        .groupBy("order_month")
        .agg(
            _n().alias("total_orders"),
            F.sum("units").cast("long").alias("units_sold"),
            money(_amount()).alias("revenue"),
            _rate().alias("return_rate_pct"),
        )
        .orderBy("order_month")
    )
