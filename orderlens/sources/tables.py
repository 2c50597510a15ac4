"""Reading and writing the retail tables, the findings document and the briefs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orderlens import schemas


class Retail(NamedTuple):
    orders: DataFrame
    products: DataFrame
    customers: DataFrame


def read_csv(spark: SparkSession, path: str, schema: StructType, as_text: bool = False) -> DataFrame:
    """A CSV file without header; a blank cell is NULL, never 0.

    With ``as_text`` every cell stays text, to be read by ``coerce_numeric``; otherwise a
    cell that does not fit its type becomes NULL and the line is kept in ``_corrupt``.
    """
    if as_text:
        schema = StructType([StructField(f.name, StringType()) for f in schema.fields])
    else:
        schema = StructType([*schema.fields, StructField("_corrupt", StringType())])
    return (
        spark.read.schema(schema)
        .option("header", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
    )


def read_retail_csv(spark: SparkSession, folder: str, raw_orders_as_text: bool = False) -> Retail:
    """The three tables; a cell that does not fit its type is an error.

    ``read_csv`` and ``quality.readable`` route such lines to the rejects instead.
    """

    def strict(name: str, schema: StructType, as_text: bool = False) -> DataFrame:
        if as_text:
            return read_csv(spark, f"{folder}/{name}.csv", schema, True)
        return spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(f"{folder}/{name}.csv")

    return Retail(
        strict("orders", schemas.ORDERS, raw_orders_as_text),
        strict("products", schemas.PRODUCTS),
        strict("customers", schemas.CUSTOMERS),
    )


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int = 5_000_000
) -> None:
    """Load typed rows into a Parquet table.

    With partition columns the rows are rebalanced first: small partitions get one file
    and a large one is split over several tasks and files.
    """
    rows = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*partition_by).parquet(path)


def write_routed(routed: DataFrame, path: str) -> None:
    """Write accepted and rejected rows in one pass, below ``rejected=false`` and ``=true``."""
    routed.withColumn("rejected", F.size("reject_reasons") > 0).write.mode("overwrite").partitionBy(
        "rejected"
    ).parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_months(spark: SparkSession, path: str, schema: StructType | str, first: str, last: str, column: str = "order_month") -> DataFrame:
    """The rows of some months of a table written by month: other months' files aren't opened."""
    return read_table(spark, path, schema).where(F.col(column).between(first, last))


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write rows in ``buckets`` files sets by ``key``, sorted by it, and read them back as such.

    Two tables with the same number of buckets of the same key are joined on it, and grouped by
    it, without a shuffle. The table's name is only needed to read the buckets back, so it goes
    again; the files stay below ``path``. Rows are dealt out by the key before they are written,
    so there is one file for each bucket. A key with a large share of the rows makes a large
    bucket: join such tables by ``spread_join`` instead.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def write_findings(document: DataFrame, path: str) -> None:
    """The findings document is one row by construction."""
    document.write.mode("overwrite").json(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FINDINGS).option("multiLine", True).json(path)


def write_briefs(briefs: DataFrame, scores: DataFrame, path: str, generated_by: str = "template") -> None:
    """Store texts with their score ``(text_id, matched, total)`` and how and when they were made."""
    stamped = briefs.join(scores.select("text_id", "matched", "total"), "text_id", "left").withColumns(
        {"generated_by": F.lit(generated_by), "generated_at": F.current_timestamp()}
    )
    stamped.write.mode("overwrite").parquet(path)
