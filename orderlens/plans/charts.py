"""The data behind the two charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.labels import month_label
from orderlens.functions.money import money, rate_pct
from orderlens.operators.enrich import fold_by_product, price_fold


def rate_by_payment(orders: DataFrame) -> DataFrame:
    """Return rate per payment method, the overall rate, and which bars are the highest."""
    per_method = (
        orders.filter(F.col("payment_method").isNotNull())
        .groupBy("payment_method")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("returned").cast("long")).alias("n_returned"))
        .withColumn("return_rate_pct", rate_pct(F.col("n_returned"), F.col("n")))
    )
    marks = per_method.agg(
        F.max("return_rate_pct").alias("highest"), rate_pct(F.sum("n_returned"), F.sum("n")).alias("overall")
    )
    mark = marks.select(F.struct("highest", "overall")).scalar()
    return per_method.select(
        "payment_method",
        "return_rate_pct",
        mark["overall"].alias("overall_rate_pct"),
        (F.col("return_rate_pct") == mark["highest"]).alias("is_highest"),
    ).orderBy("payment_method")


def monthly_revenue(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue per month of cleaned orders."""
    dated = orders.withColumn("month", month_label(F.col("order_date")))
    return (
        price_fold(fold_by_product(dated, "month"), products)
        .groupBy("month")
        .agg(money(F.sum("amount")).alias("revenue"))
        .orderBy("month")
    )
