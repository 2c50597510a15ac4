"""Attach product and customer attributes to order rows, and value them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.labels import month_label
from orderlens.functions.money import CENTS, line_value, net_units, priced, with_cents
from orderlens.operators.skew import HotKeys, fold, spread_join


def one_row_per_key(dimension: DataFrame, key: str) -> DataFrame:
    """``dimension`` without NULL keys, which join to nothing; reading a key that repeats raises an error.

    A repeated key would multiply orders and money in every join to it. The check is part of
    the plan: rows are numbered per key behind the exchange and the sort that a join on the key
    asks for, and the second row of a key raises. Nothing runs while a plan is built, and no
    group is gathered.
    """
    number = "_row_of_key"
    numbered = dimension.where(F.col(key).isNotNull()).withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    message = F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" occurs more than once in a dimension"))
    unique = F.when(F.col(number) > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return numbered.where(unique).drop(number)


def order_value(
    orders: DataFrame, products: DataFrame, hot: HotKeys | None = None, how: str = "inner"
) -> DataFrame:
    """Every order row with its product attributes and its value."""
    joined = spread_join(orders, with_cents(one_row_per_key(products, "product_id")), "product_id", how, hot)
    return joined.withColumn("order_value", line_value(joined)).drop(CENTS)


def enrich_orders(
    orders: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    hot_products: HotKeys | None = None,
    hot_customers: HotKeys | None = None,
) -> DataFrame:
    """Left joins to both dimensions, with the value and the month of each order.

    Customers come first: orders that are partitioned by customer already stay where they are, and
    the names of products aren't shuffled.
    """
    joined = spread_join(orders, one_row_per_key(customers, "customer_id"), "customer_id", "left", hot_customers)
    joined = order_value(joined, products, hot_products, "left")
    return joined.withColumn("month", month_label(F.col("order_date")))


def fold_by_product(orders: DataFrame, *keys: str) -> DataFrame:
    """Additive measures per product (and ``keys``), before any price is known.

    The value of a line is net units times price, so the value of all lines of a product
    is the sum of net units times price: the join to the products comes after the fold.
    """
    net = net_units(orders)
    return fold(
        orders,
        ["product_id", *keys],
        n=F.lit(1).cast("long"),
        n_returned=F.col("returned").cast("long"),
        units=F.col("quantity"),
        net=net,
        net_returned=F.when(F.col("returned") == 1, net).otherwise(F.lit(0)),
    )


def price_fold(folded: DataFrame, products: DataFrame) -> DataFrame:
    """Turn folded net units into money by the price of the product."""
    return (
        folded.join(one_row_per_key(products, "product_id"), "product_id")
        .withColumn("amount", priced(F.col("net"), F.col("price")))
        .withColumn("amount_returned", priced(F.col("net_returned"), F.col("price")))
        .drop("net", "net_returned")
    )


def fold_by_customer(valued: DataFrame, *keys: str) -> DataFrame:
    """Additive measures per customer (and ``keys``) of valued order rows."""
    return fold(
        valued,
        ["customer_id", *keys],
        n=F.lit(1).cast("long"),
        n_returned=F.col("returned").cast("long"),
        amount=F.col("order_value"),
    )
