"""Customer totals, spend tiers and repeat returners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.labels import spend_tier
from orderlens.functions.money import money, rate_pct
from orderlens.operators.enrich import one_row_per_key


def customer_rollup(valued: DataFrame) -> DataFrame:
    """Orders, spend, returns, mean rating and return rate of each customer."""
    return (
        valued.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("orders"),
            F.coalesce(F.sum("order_value"), F.lit(0)).alias("amount"),
            F.sum(F.col("returned").cast("long")).alias("returns"),
            F.avg("rating").alias("avg_rating"),
        )
        .withColumn("return_rate", rate_pct(F.col("returns"), F.col("orders")))
    )


def customer_segments(
    valued: DataFrame, customers: DataFrame, edges: Sequence[float] = (1200, 2500)
) -> DataFrame:
    """The rollup with its spend tier and the attributes of the customer."""
    attributes = one_row_per_key(customers.select("customer_id", "city", "city_tier", "acquisition_source"), "customer_id")
    return (
        customer_rollup(valued)
        .withColumn("segment", spend_tier(F.col("amount"), edges))
        .join(attributes, "customer_id", "left")
        .withColumn("spend", money(F.col("amount")))
    )


def segment_summary(rollup: DataFrame, edges: Sequence[float] = (1200, 2500)) -> DataFrame:
    """Customers and means per spend tier."""
    n = F.count(F.lit(1))

    def mean(total):
        return F.round(F.try_divide(total.cast("double"), n), 2)

    return (
        rollup.groupBy(spend_tier(F.col("amount"), edges).alias("segment"))
        .agg(
            n.alias("customers"),
            mean(F.sum("orders")).alias("avg_orders"),
            mean(F.sum("amount")).alias("avg_spend"),
            mean(F.sum(F.col("return_rate").cast("decimal(9,2)"))).alias("avg_return_rate"),
        )
        .filter(F.col("segment").isNotNull())
        .orderBy("avg_spend")
    )


def repeat_returners(rollup: DataFrame, customers: DataFrame, min_orders: int = 3, top: int = 5) -> DataFrame:
    """Highest return rates among customers with enough orders.

    The best rows are picked before the join: it is a left join, so it drops none.
    """
    best = (
        rollup.filter(F.col("orders") >= min_orders)
        .orderBy(F.desc("return_rate"), F.desc("orders"), "customer_id")
        .limit(top)
    )
    return (
        best.join(one_row_per_key(customers.select("customer_id", "city"), "customer_id"), "customer_id", "left")
        .select("customer_id", "orders", "returns", "return_rate", money(F.col("amount")).alias("spend"), "city")
        .orderBy(F.desc("return_rate"), F.desc("orders"), "customer_id")
    )
