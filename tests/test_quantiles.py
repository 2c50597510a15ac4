import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators import outliers, quantiles

CASES = {
    "uniform": np.random.default_rng(1).uniform(-5, 100, 5000),
    "one value holds a third": np.concatenate(
        [np.full(2000, 7.25), np.random.default_rng(2).normal(0, 1e6, 4000)]
    ),
    "few values": np.random.default_rng(3).integers(1, 4, 501).astype(float),
    "wide range": np.exp(np.random.default_rng(4).uniform(-300, 300, 3001)),
    "single": np.array([3.5]),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_numpy(spark, monkeypatch, name):
    monkeypatch.setattr(quantiles, "CELLS", 64)
    values = CASES[name]
    rows = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "v double").repartition(3)
    wanted = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = quantiles.exact_quantiles(df, "v", wanted)
    assert found == pytest.approx(list(np.quantile(values, wanted)), rel=1e-12)


HARD = {
    "infinities": [float("inf")] * 30 + [float("-inf")] * 5 + [i / 7 for i in range(65)],
    "whole range": [s * 1.7e308 * k / 40 for k in range(41) for s in (-1, 1)],
    "tiny": [5e-324 * k for k in range(40)],
    "one third": [2.5] * 40 + [0.1 * k for k in range(77)],
    "many": [((k * 7919) % 12007) / 3 for k in range(12007)],
}


@pytest.mark.parametrize("name", HARD)
def test_equals_the_built_in_percentile(spark, name):
    df = spark.createDataFrame([(v,) for v in HARD[name]], "v double")
    wanted = [0.0, 0.05, 0.25, 0.5, 0.7, 0.75, 0.99, 1.0]
    exact = df.agg(F.percentile("v", wanted)).first()[0]
    assert repr(quantiles.exact_quantiles(df, "v", wanted)) == repr(list(exact))


def test_empty_column(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(df, "v", [0.5]) == [None]
    assert outliers.iqr_summary(df, "v").first()["flagged_rows"] == 0


def test_several_columns_at_once(spark):
    df = spark.createDataFrame([(i, 10 * i) for i in range(11)], "a int, b int")
    assert quantiles.quantiles_of(df, {"a": [0.5], "b": [0.25, 0.75]}) == {"a": [5.0], "b": [25.0, 75.0]}


def test_outliers_are_flagged_and_kept(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 2, 2, 2, 3, 3, 25, None]], "v int")
    flagged = outliers.flag_outliers(df, "v")
    assert flagged.count() == 9
    assert [r["v"] for r in flagged.filter("is_outlier").collect()] == [25]
    assert [r["v"] for r in outliers.outlier_rows(df, "v").collect()] == [25]


def python_quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def test_quantiles_of_groups(spark):
    pick = random.Random(7)
    rows = [("hot", pick.gauss(0, 1e6)) for _ in range(40_000)] + [("same", 5.5)] * 3000
    rows += [(f"g{i % 300}", pick.choice([float(i % 11), -1e308, 1e308, 2.5])) for i in range(3000)]
    rows += [(None, float(i)) for i in range(50)] + [("empty", None), ("empty", math.nan), ("one", 7.0), ("one", None)]
    rows += [("ends", math.inf), ("ends", -math.inf), ("ends", 1.0), ("ends", math.inf), ("ends", 0.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    wanted = [0.0, 0.25, 0.5, 0.9, 1.0]
    groups = {}
    for k, x in rows:
        groups.setdefault(k, [])
        if x is not None and not math.isnan(x):
            groups[k].append(x)
    got = {r["k"]: (r["n_values"], r["quantiles"]) for r in quantiles.grouped_quantiles(df, ["k"], "x", wanted).collect()}
    assert got == {k: (len(v), [python_quantile(v, p) if v else None for p in wanted]) for k, v in groups.items()}


def test_group_passes_do_not_grow_with_groups(spark):
    df = spark.range(5000).selectExpr("id % 1000 AS a", "id % 3 AS b", "cast(id * id % 1009 AS double) AS x")
    small = quantiles.grouped_quantiles(df, ["b"], "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    large = quantiles.grouped_quantiles(df, ["a"], "x", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert abs(len(small.splitlines()) - len(large.splitlines())) < 20
    assert quantiles.grouped_quantiles(df.limit(0), ["a", "b"], "x", [0.5]).count() == 0


def test_flags_of_groups(spark):
    rows = [("a", float(i)) for i in range(100)] + [("a", 1000.0), ("b", 1000.0), ("b", 1001.0), (None, 1.0), (None, None)]
    flagged = outliers.flag_by_group(spark.createDataFrame(rows, "k string, x double"), ["k"], "x")
    assert flagged.count() == len(rows) and [tuple(r) for r in flagged.where("is_outlier").collect()] == [("a", 1000.0, True)]
