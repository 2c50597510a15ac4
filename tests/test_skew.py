from collections import Counter

import pytest
from pyspark.sql import functions as F

from orderlens.operators.skew import NO_HOT_KEYS, hot_keys, salt_count, spread_join


@pytest.fixture(scope="module")
def fact(spark):
    """A third of the rows share one key, and most of those are exact copies of one row."""
    rows = [(None if i % 7 == 0 else (5 if i % 3 == 0 else 1000 + i), 0 if i % 3 == 0 else i) for i in range(6000)]
    return spark.createDataFrame(rows, "k int, payload int").repartition(6)


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([(i, f"d{i}") for i in [5, *range(1000, 5000)]], "k int, label string")


def rows(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_hot_keys_finds_the_heavy_key_and_nulls(fact):
    assert hot_keys(fact, "k") == NO_HOT_KEYS
    hot = hot_keys(fact, "k", share=0.005, min_rows=0)
    assert hot.values == (5,)
    assert hot.null_share > 0.1 and 0.25 < hot.shares[0] < 0.34


def test_a_small_share_is_hot_for_many_partitions(spark):
    df = spark.range(20_000).selectExpr("if(id % 500 = 0, 7, id + 100) as k", "id as payload")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        hot = hot_keys(df, "k", min_rows=0)
        assert hot.values == (7,) and hot.shares == (0.002,)
        spread = spread_join(df, spark.createDataFrame([(7, "x")], "k long, label string"), "k", "left", hot)
        assert spread.count() == 20_000 and salt_count(df, hot.shares[0]) == 4 and salt_count(df, 0.0001) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_hot_key_leaves_a_plain_join(fact, dim):
    even = fact.filter("k >= 1000")
    assert hot_keys(even, "k", min_rows=0) == NO_HOT_KEYS
    assert spread_join(even, dim, "k").columns == ["k", "payload", "label"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_spread_join_equals_plain_join(spark, fact, dim, how, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        hot = hot_keys(fact, "k", min_rows=0)
        assert rows(spread_join(fact, dim, "k", how, hot)) == rows(fact.join(dim, "k", how))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_a_hot_key_land_in_several_partitions(spark, fact, dim):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = (
            spread_join(fact, dim, "k", "left", hot_keys(fact, "k", min_rows=0))
            .filter("k = 5")
            .groupBy(F.spark_partition_id().alias("p"))
            .count()
            .collect()
        )
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(parts) > 1
    assert max(p["count"] for p in parts) < sum(p["count"] for p in parts)
