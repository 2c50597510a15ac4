"""Session settings and the shared folder for data that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "orderlens", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session in one local process, as in tests, may lack that setting and gets a folder
    of its own; with executors on other machines a machine-local folder would be wrong.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_dir()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="orderlens-")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several aggregates read one expensive frame: the copy survives lost
    executors and each reader still loads only its own columns.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_STAGED: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder, remembered for ``drop_staged``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


_GENERATION = [0]


def staged_generation() -> int:
    """Grows when staged tables are dropped: whatever reads older ones is void."""
    return _GENERATION[0]


def drop_staged(spark: SparkSession) -> None:
    """Delete what this process has staged, once no result needs it any more."""
    _GENERATION[0] += 1
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
