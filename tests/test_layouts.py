"""Tables by month and by bucket, JSON of any shape, and state that later batches are merged into."""

import json

import pytest
from pyspark.sql import functions as F

from orderlens.functions.leaves import json_leaves
from orderlens.operators import cleaning
from orderlens.plans import reports
from orderlens.session import new_path
from orderlens.sources.tables import read_months, read_table, write_bucketed, write_table
from tests.conftest import as_dicts


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_months_are_pruned(spark, retail):
    dated = retail.orders.withColumn("order_month", F.date_format("order_date", "yyyy-MM"))
    path = new_path(spark, "by-month")
    write_table(dated, path, ["order_month"])
    some = read_months(spark, path, dated.schema, "2026-02", "2026-03")
    assert "PartitionFilters: [isnotnull(order_month" in plan(some)
    assert len(some.inputFiles()) >= 2 and {f.split("order_month=")[1][:7] for f in some.inputFiles()} >= {"2026-02"}
    rows = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("order_month=")[1][:7] for r in rows} == {"2026-02", "2026-03"}
    want = [r for r in as_dicts(reports.monthly_trend(retail.orders, retail.products)) if r["order_month"] in ("2026-02", "2026-03")]
    assert as_dicts(reports.monthly_trend(some, retail.products)) == want
    latest = dated.agg(F.max("order_month")).scalar()
    recent = read_table(spark, path, dated.schema).where(F.col("order_month") >= latest)
    scan = next(line for line in plan(recent).splitlines() if "PartitionFilters" in line)
    assert "Subquery" in scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert [r["order_month"] for r in recent.select("order_month").distinct().collect()] == ["2026-04"]


def test_buckets_are_joined_without_an_exchange(spark, no_broadcast):
    lines = spark.range(2000).selectExpr("id % 300 AS order_key", "id AS line")
    headers = spark.range(300).selectExpr("id AS order_key", "id * 2 AS customer")
    a = write_bucketed(lines, new_path(spark, "lines"), "order_key", 4)
    b = write_bucketed(headers, new_path(spark, "headers"), "order_key", 4)
    joined = a.join(b, "order_key")
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    assert "Exchange" not in plan(joined.groupBy("order_key").count())
    assert joined.count() == 2000 and joined.where("customer <> 2 * order_key").count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def leaves_in_python(value, path=()):
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in leaves_in_python(v, (*path, k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in leaves_in_python(v, (*path, str(i)))]
    if value is None:
        return []
    if isinstance(value, bool):
        return [(".".join(path), str(value).lower(), None)]
    return [(".".join(path), None, float(value))] if isinstance(value, int | float) else [(".".join(path), value, None)]


def test_json_of_any_shape(spark):
    texts = [
        {"a": 1, "b": {"c": [1.5, True, None, "x", {"d": [[], [2], {}]}]}, "e": None},
        [1, [2, [3, [4, {"deep": False}]]]], 7, "plain", True, {}, [], {"n": 12345678901234, "f": 1e-7, "neg": -0.25, "big": 1e300},
        {"ü.k": "é\"\\\n", "": 0},
    ]
    rows = [(i, json.dumps(t)) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "{broken"), (93, "null")]
    got = sorted(map(tuple, json_leaves(spark.createDataFrame(rows, "id int, doc string"), "doc", "id").collect()), key=str)
    assert got == sorted([(i, *leaf) for i, t in enumerate(texts) for leaf in leaves_in_python(t)], key=str)


def test_batches_merge_to_the_state_of_all_rows(spark, retail):
    valued = cleaning.typed_orders(retail.orders).withColumn("amount", F.col("quantity").cast("decimal(12,2)"))
    whole = as_dicts(cleaning.reconcile(valued, "amount"))
    number = F.substring("order_id", 2, 9).cast("int")
    for cuts in ([number % 2 == 0, number % 2 == 1], [number > 100, number <= 30, (number > 30) & (number <= 100), F.lit(False)]):
        state = None
        for cut in cuts:
            batch = cleaning.copy_state(valued.where(cut), "amount")
            state = batch if state is None else cleaning.merge_state(state, batch)
        assert as_dicts(cleaning.reconcile_state(state)) == whole
