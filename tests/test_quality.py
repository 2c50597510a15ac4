import datetime as dt
from decimal import Decimal

import pytest

from orderlens import schemas
from orderlens.operators import quality
from orderlens.operators.skew import NO_HOT_KEYS
from orderlens.sources.tables import read_csv, read_table, write_routed, write_table
from tests.conftest import as_dicts

GOOD = ("O1", "C00", "P0", dt.date(2026, 1, 1), 1, 0, "card", 5, 0)
BAD = {
    "order_id not null": (0, None),
    "customer_id not null": (1, None),
    "order_date not null": (3, None),
    "quantity not null": (4, None),
    "quantity in range": (4, 0),
    "discount_pct in range": (5, 101),
    "rating in range": (7, 6),
    "returned in domain": (8, 2),
}


def problems(df):
    return {r["check_name"]: r["problems"] for r in df.collect()}


def test_clean_tables_pass(retail):
    for name, df in zip(("orders", "products", "customers"), retail):
        assert set(problems(quality.count_violations(df, quality.declared_checks(name))).values()) == {0}


@pytest.mark.parametrize("check", BAD)
def test_each_constraint_reports_its_violation(spark, check):
    position, value = BAD[check]
    row = list(GOOD)
    row[position] = value
    df = spark.createDataFrame([GOOD, tuple(row)], schemas.ORDERS)
    found = problems(quality.count_violations(df, quality.declared_checks("orders")))
    assert {name for name, n in found.items() if n} == {check}
    assert found[check] == 1


def test_null_passes_domain_and_range(spark):
    df = spark.createDataFrame([("P1", "x", None, Decimal("1.00"))], schemas.PRODUCTS)
    assert set(problems(quality.count_violations(df, quality.declared_checks("products"))).values()) == {0}


def test_routing_splits_rows_and_names_reasons(spark, retail):
    rows = [GOOD, GOOD[:1] + ("C99",) + GOOD[2:], GOOD[:4] + (-1,) + GOOD[5:], GOOD[:1] + (None,) + GOOD[2:]]
    df = spark.createDataFrame(rows, schemas.ORDERS)
    references = [
        ("customer_id", retail.customers, "customer_id", NO_HOT_KEYS),
        ("product_id", retail.products.unionByName(retail.products), "product_id", None),
    ]
    routed = quality.route(df, quality.declared_checks("orders"), references).cache()
    assert routed.count() == 4
    assert quality.accepted(routed).count() == 1
    reasons = sorted(tuple(r["reject_reasons"]) for r in quality.rejected(routed).collect())
    assert reasons == [("customer_id not null",), ("customer_id unknown",), ("quantity in range",)]


def test_later_rows_of_a_primary_key_are_rejected(spark, tmp_path):
    rows = [("a", 1), ("a", 3), ("a", 2), ("b", 4), (None, 5)]
    df = spark.createDataFrame(rows, "id string, arrival int")
    routed = quality.route(df, quality.not_null(["id"]), unique=("id", "arrival"))
    assert sorted(r["arrival"] for r in quality.accepted(routed).collect()) == [1, 4]
    write_routed(routed, str(tmp_path / "routed"))
    columns = "id string, arrival int, reject_reasons array<string>, rejected boolean"
    back = read_table(spark, str(tmp_path / "routed"), columns)
    reasons = {r["arrival"]: r["reject_reasons"] for r in back.filter("rejected").collect()}
    assert reasons == {2: ["id repeated"], 3: ["id repeated"], 5: ["id not null"]}


def test_keys_orphans_and_join_counts(spark):
    fact = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")
    dim = spark.createDataFrame([(1,), (2,), (2,)], "d int")
    (repeated,) = as_dicts(quality.repeated_keys(dim, ["d"], "dim"))
    assert (repeated["problems"], repeated["surplus_rows"]) == (1, 1)
    (orphan,) = as_dicts(quality.orphans(fact, dim, "k", "d", "fact"))
    assert (orphan["problems"], orphan["orphan_keys"]) == (1, 1)
    (count,) = as_dicts(quality.join_row_count(fact, dim, "k", "d", "join"))
    assert (count["rows_before"], count["rows_after"], count["preserved"]) == (5, 6, False)
    assert fact.join(dim, fact.k == dim.d, "left").count() == 6


def test_profile(retail):
    found = {(r["metric"], r["item"]): r["value"] for r in quality.profile_orders(retail.orders).collect()}
    assert found[("rows", None)] == 125
    assert found[("missing discount_pct", None)] == 11
    assert found[("quantity above 5", None)] == 3
    assert found[("payment_method spellings", None)] == sum(1 for m, _ in found if m == "payment_method spelling")


def test_csv_blank_is_null_and_roundtrip_keeps_rows(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("O1,C1,P1,2026-01-02,2,,Card,,0\nO2,C1,P1,2026-02-02,x,10,Card,3,1\n")
    df = read_csv(spark, str(tmp_path / "orders.csv"), schemas.ORDERS)
    first, second = sorted(df.collect(), key=lambda r: r["order_id"])
    assert first["discount_pct"] is None and first["rating"] is None and first["_corrupt"] is None
    assert second["quantity"] is None and second["_corrupt"].startswith("O2")
    plain = df.drop("_corrupt").selectExpr("*", "date_format(order_date, 'yyyy-MM') AS month")
    write_table(plain, str(tmp_path / "out"), ["month"])
    back = read_table(spark, str(tmp_path / "out"), plain.schema)
    assert sorted(map(str, back.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
