"""The benchmark's star schema seen as orders, products and customers.

One order row is one line item. Its product side needs ``lineitem`` alone, so reports
that do not ask for the customer, the date or the payment read ``retail_lines`` and skip
the join to the order headers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.money import PRICE
from orderlens.operators.skew import HotKeys, hot_keys, spread_join


# Declared, so that reading a table starts no job to infer its schema.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


_HOT: dict[tuple[str, str, str, str], HotKeys] = {}


def hot(spark: SparkSession, folder: str, name: str, column: str) -> HotKeys:
    """Hot keys of one column, looked up once per session and table."""
    wanted = (spark.sparkContext.applicationId, folder, name, column)
    if wanted not in _HOT:
        _HOT[wanted] = hot_keys(table(spark, folder, name), column)
    return _HOT[wanted]


def forget_hot_keys() -> None:
    """Look hot keys up anew from now on."""
    _HOT.clear()


def hot_customers(spark: SparkSession, folder: str) -> HotKeys:
    """Customers with many orders, and the customers of orders with many lines."""
    many_orders = hot(spark, folder, "orders", "o_custkey")
    many_lines = hot(spark, folder, "lineitem", "l_orderkey")
    if not many_lines.values:
        return many_orders
    owners = table(spark, folder, "orders").filter(F.col("o_orderkey").isin(*many_lines.values))
    keys = {row["o_custkey"] for row in owners.select("o_custkey").distinct().collect()}
    values = tuple(sorted({*many_orders.values, *keys} - {None}))
    known = dict(zip(many_orders.values, many_orders.shares, strict=True))
    most = max(many_lines.shares)
    return HotKeys(values, tuple(max(known.get(v, 0.0), most if v in keys else 0.0) for v in values), many_orders.null_share)


def messy_priority(key, label):
    """The order priority in three spellings, to stand in for a free-text payment method."""
    return (
        F.when(key % 3 == 0, F.lower(label))
        .when(key % 3 == 1, F.concat(F.lit("  "), label, F.lit(" ")))
        .otherwise(label)
    )


def retail_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order rows with everything a line item knows."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.nullif(F.round(F.col("l_discount") * 100).cast("int"), F.lit(0)).alias("discount_pct"),
        F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")).alias("rating"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"),
    )


def order_headers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        messy_priority(F.col("o_orderkey"), F.col("o_orderpriority")).alias("payment_method"),
    )


def retail_orders(spark: SparkSession, folder: str, hashed: bool = False) -> DataFrame:
    """Order rows with customer, date and payment method from the order header.

    ``hashed`` headers are held as a hash table in each task, so the lines aren't sorted.
    """
    headers = order_headers(spark, folder)
    return spread_join(
        retail_lines(spark, folder),
        headers.hint("shuffle_hash") if hashed else headers,
        "order_key",
        hot=hot(spark, folder, "lineitem", "l_orderkey"),
        spread_by=["product_id", "quantity", "rating"],
    )


def retail_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Raw order rows with later copies: unrated lines of an even quantity arrive twice,
    the copy with another spelling of its payment method."""
    twice = F.col("rating").isNull() & (F.col("quantity") % 2 == 0)
    arrivals = F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    method = F.when(F.col("arrival") == 1, F.lower("payment_method")).otherwise(F.col("payment_method"))
    return (
        retail_orders(spark, folder, hashed=True)
        .withColumn("arrival", F.explode(arrivals))
        .select(
            F.concat_ws("-", "order_id", "arrival").alias("order_id"),
            "customer_id",
            "product_id",
            "order_date",
            "quantity",
            "discount_pct",
            method.alias("payment_method"),
            "rating",
            "returned",
        )
    )


def retail_products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast(PRICE).alias("price"),
    )


def retail_customers(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.col("n_name").alias("city"),
        F.when(F.col("n_regionkey") <= 1, 1).otherwise(2).alias("city_tier"),
    )
    return (
        table(spark, folder, "customer")
        .join(nations, "c_nationkey")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            "city",
            "city_tier",
            F.col("c_mktsegment").alias("acquisition_source"),
        )
    )


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as raw order rows in text form, with copies, blanks and bad cells.

    Within one user, event type and day all columns of the copy key agree up to spelling,
    except that some discounts are blank.
    """
    event, user = F.col("event_id"), F.col("user_id")
    method = F.element_at(F.array(F.lit("Card"), F.lit("cod"), F.lit("UPI")), (user % 3 + 1).cast("int"))
    spelled = (
        F.when(event % 4 == 0, F.upper(method))
        .when(event % 4 == 1, F.concat(F.lit("\t"), method, F.lit("\n")))
        .when(event % 4 == 2, F.lower(method))
        .otherwise(method)
    )
    return table(spark, folder, "events").select(
        event.alias("order_id"),
        user.alias("customer_id"),
        F.col("event_type").alias("product_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("order_date"),
        F.concat(F.lit(" "), (user % 5 + 1).cast("string")).alias("quantity"),
        F.when(event % 10 == 0, "").otherwise((user % 4 * 10).cast("string")).alias("discount_pct"),
        spelled.alias("payment_method"),
        F.when(event % 11 == 0, "n/a")
        .when(event % 13 == 0, "12x")
        .otherwise((F.regexp_extract("props", "[0-9]+", 0).cast("int") % 5 + 1).cast("string"))
        .alias("rating"),
        F.when(event % 3 == 0, "1").otherwise("0").alias("returned"),
        F.col("value").cast("decimal(18,2)").alias("amount"),
    )
