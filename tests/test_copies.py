"""Removal of copies by a bit table against plain Python, and the plans it promises."""

import random

import pytest
from pyspark.sql import functions as F

from orderlens.operators import cleaning
from orderlens.operators.copies import by_repeats
from tests.conftest import as_dicts

SCHEMA = "order_id string, a string, b int, value double, note string"


def rows(seed, n, keys):
    pick = random.Random(seed)
    made = [(f"O{i:05}", pick.choice([None, *map(str, range(keys))]), pick.choice([None, 1, 2]), float(i % 7), pick.choice([None, "x", "y"])) for i in range(n)]
    pick.shuffle(made)
    return made


@pytest.mark.parametrize("bits", [6, 12, 20])
@pytest.mark.parametrize("keys", [3, 200, 5000])
def test_equals_python(spark, bits, keys):
    made = rows(keys, 900, keys)
    best, count, total = {}, {}, {}
    for r in made:
        k = r[1:3]
        best[k] = min(best.get(k, r), r, key=lambda x: x[0])
        count[k], total[k] = count.get(k, 0) + 1, total.get(k, 0.0) + r[3]
    df = spark.createDataFrame(made, SCHEMA).repartition(5)
    kept = cleaning.keep_first(df, ["a", "b"], count_as="n", sums={"total": F.col("value")}, bits=bits)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(((*r, count[k], total[k]) for k, r in best.items()), key=str)
    assert sorted(map(tuple, cleaning.fold_first(df, ["a", "b"]).collect()), key=str) == sorted(best.values(), key=str)
    removed = cleaning.removed_copies(df, ["a", "b"], bits=bits)
    assert sorted(r["order_id"] for r in removed.collect()) == sorted({r[0] for r in made} - {r[0] for r in best.values()})
    alone, several = by_repeats(df, ["a", "b"], bits)
    assert alone.count() + several.count() == len(made) and alone.groupBy("a", "b").count().where("count > 1").count() == 0


def test_equal_rows_and_ties_leave_one(spark):
    df = spark.createDataFrame([("O1", "k", 1, 1.0, None)] * 500 + [("O1", "k", 1, None, "x"), ("O1", "k", 1, 1.0, "x"), ("O9", "k", 1, 0.0, "y"), (None, "z", 1, 0.0, "y"), ("O7", "z", 1, 0.0, "y")], SCHEMA)
    kept = {r["a"]: r for r in as_dicts(cleaning.keep_first(df, ["a"], count_as="n"))}
    assert kept["k"]["order_id"] == "O1" and kept["k"]["n"] == 503
    assert kept["z"]["order_id"] is None and kept["z"]["n"] == 2 and len(kept) == 2
    assert cleaning.keep_first(df.limit(0), ["a"]).count() == 0


def test_whole_rows_are_neither_sorted_nor_shuffled_where_keys_are_alone(spark):
    df = spark.range(1000).selectExpr("id AS order_id", "cast(id AS string) AS a", "repeat('w', 50) AS note")
    plan = cleaning.keep_first(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert not [line for line in plan.splitlines() if "Sort" in line and "note" in line]
    removed = cleaning.removed_copies(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in removed.splitlines() if "Exchange" in line and "hashpartitioning(order_id" in line]) == 2
    kept = cleaning.keep_first(df, ["a"])
    assert kept.count() == 1000
