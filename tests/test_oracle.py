"""Every registered query against its SQL in another engine, and a look at its plan."""

import os

import duckdb
import pytest

from orderlens.plans.oracle import ORACLE
from orderlens.plans.registry import QUERIES
from orderlens.session import drop_staged

FOLDER = os.environ.get("ORDERLENS_TESTDATA", "/root/testdata/sf0.001")
TABLES = "nation customer part orders lineitem events documents".split()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not found")


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, other, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    columns = sorted(df.columns)
    found = [tuple(row[c] for c in columns) for row in df.collect()]
    drop_staged(spark)
    if name not in ORACLE:
        assert found
        return
    result = other.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)
