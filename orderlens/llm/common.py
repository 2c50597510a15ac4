"""What the operators of this package share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and Python: rows may be long.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches handed to Python workers, so that long texts don't pile up in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(work, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def apart(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with every column but ``own`` named by its place, so that no helper column of an
    operator can clash with it; ``toDF(*docs.columns)`` gives the names back."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in own else f"given_{i}") for i, c in enumerate(docs.columns)))
