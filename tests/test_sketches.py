"""Sketches and co-moments in cells, merged, against exact figures of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators import correlation, sketches


@pytest.fixture(scope="module")
def rows(spark):
    made = "id % 37 AS cell", "id % 5 AS coarse", "xxhash64(id % 30011) AS who", "cast(pmod(xxhash64(id), 100003) AS double) AS v"
    return spark.range(120_000).selectExpr(*made).cache()


def test_merged_distinct_counts_stay_within_their_error(rows):
    cells = sketches.distinct_cells(rows, ["cell", "coarse"], "who")
    for keys in ([], ["coarse"], ["cell"]):
        exact = {tuple(r[k] for k in keys): r["x"] for r in rows.groupBy(*keys).agg(F.count_distinct("who").alias("x")).collect()}
        for r in sketches.distinct_of(cells, *keys).collect():
            assert abs(r["estimate"] - exact[tuple(r[k] for k in keys)]) <= np.ceil(sketches.DISTINCT_ERROR * exact[tuple(r[k] for k in keys)])
    assert sketches.distinct_of(cells).first()["n"] == 120_000


def test_merged_quantiles_stay_within_their_rank_error(rows):
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    cells = sketches.quantile_cells(rows, ["cell", "coarse"], "v")
    values = np.sort([r["v"] for r in rows.select("v").collect()])
    merged = sketches.quantiles_of_cells(cells, shares).collect()
    at_once = sketches.quantiles_of_cells(sketches.quantile_cells(rows, [], "v"), shares).collect()
    assert len(merged) == len(at_once) == len(shares)
    for r in [*merged, *at_once]:
        below, upto = np.searchsorted(values, r["estimate"], "left"), np.searchsorted(values, r["estimate"], "right")
        slack = sketches.RANK_ERROR * len(values) + 1
        assert r["n_values"] == len(values) and below <= r["p"] * len(values) + slack and upto >= r["p"] * len(values) - slack


def test_cells_without_values(spark):
    df = spark.createDataFrame([("a", None, None), ("b", float("nan"), "x"), ("b", 3.0, None)], "k string, v double, who string")
    assert [(r["k"], r["estimate"]) for r in sketches.quantiles_of_cells(sketches.quantile_cells(df, ["k"], "v"), [0.5], "k").collect()] == [("b", 3.0)]
    found = {r["k"]: r["estimate"] for r in sketches.distinct_of(sketches.distinct_cells(df, ["k"], "who"), "k").collect()}
    assert found == {"a": 0, "b": 1}


def test_merged_moments_equal_one_pass(spark):
    pick = np.random.default_rng(2)
    n = 5000
    a = pick.normal(1e6, 1, n)
    rows = [(int(i % 61), float(a[i]), float(2 * a[i] + pick.normal()), 0.1, None if i % 3 else float(i % 10), None) for i in range(n)]
    df = spark.createDataFrame(rows, "cell int, a double, b double, c double, d double, e double")
    columns = ["a", "b", "c", "d", "e"]
    one = {(r["var_x"], r["var_y"]): r["r"] for r in correlation.correlation_matrix(df.drop("cell"), columns).collect()}
    cells = df.groupBy("cell").agg(*correlation.moments(columns))
    merged = {(r["var_x"], r["var_y"]): r["r"] for r in correlation.merged_matrix(cells, columns).collect()}
    for pair, r in merged.items():
        if "c" in pair or "e" in pair:
            assert r is None
        else:
            assert r == pytest.approx(one[pair], abs=0.0011), pair
    assert correlation.merged_matrix(cells.limit(0), columns).where("r IS NOT NULL").count() == 0
