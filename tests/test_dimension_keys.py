"""A key that repeats in a dimension stops every plan that joins it, and only when the plan runs."""

import uuid

import pytest

from orderlens.operators import enrich, rates, segments
from orderlens.operators.skew import NO_HOT_KEYS
from orderlens.plans import reports
from tests.conftest import as_dicts


def valued(retail, products):
    return enrich.order_value(retail.orders, products, NO_HOT_KEYS)


CUSTOMER_JOINS = {
    "report4": lambda r, p, c: reports.top_returning_customers(r.orders, c),
    "report5": lambda r, p, c: reports.city_performance(r.orders, p, c, NO_HOT_KEYS),
    "report6": lambda r, p, c: reports.channel_roi(r.orders, p, c, NO_HOT_KEYS),
    "segments": lambda r, p, c: segments.customer_segments(valued(r, p), c),
    "returners": lambda r, p, c: segments.repeat_returners(segments.customer_rollup(valued(r, p)), c),
    "risk": lambda r, p, c: rates.risk_segments(r.orders, c),
    "rates": lambda r, p, c: rates.rates_by_dimension(r.orders, p, c),
    "enriched": lambda r, p, c: enrich.enrich_orders(r.orders, p, c, NO_HOT_KEYS, NO_HOT_KEYS),
}
PRODUCT_JOINS = {
    "report2": lambda r, p, c: reports.returns_by_category(r.orders, p),
    "report7": lambda r, p, c: reports.product_loss(r.orders, p),
    "rates": CUSTOMER_JOINS["rates"],
    "values": lambda r, p, c: valued(r, p),
}


@pytest.mark.parametrize("name", CUSTOMER_JOINS)
@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_a_doubled_customer_raises(spark, retail, name, broadcast):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        doubled = retail.customers.unionByName(retail.customers.where("customer_id = 'C03'"))
        with pytest.raises(Exception, match="customer_id C03 occurs more than once"):
            CUSTOMER_JOINS[name](retail, retail.products, doubled).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("name", PRODUCT_JOINS)
def test_a_doubled_product_raises(spark, retail, name):
    doubled = retail.products.unionByName(retail.products.where("product_id = 'P2'"))
    with pytest.raises(Exception, match="product_id P2 occurs more than once"):
        PRODUCT_JOINS[name](retail, doubled, retail.customers).collect()


def test_null_keys_may_repeat(spark, retail):
    nobody = retail.customers.limit(1).selectExpr("cast(null AS string) AS customer_id", "* EXCEPT (customer_id)")
    more = retail.customers.unionByName(nobody).unionByName(nobody)
    for name, build in CUSTOMER_JOINS.items():
        assert as_dicts(build(retail, retail.products, more)) == as_dicts(build(retail, retail.products, retail.customers)) or name == "enriched"


def test_building_starts_no_job(spark, retail):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "build only")
    try:
        for build in (*CUSTOMER_JOINS.values(), *PRODUCT_JOINS.values()):
            build(retail, retail.products, retail.customers)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_check_shares_the_exchange_of_the_join(spark, retail, capsys, monkeypatch):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rates.risk_segments(retail.orders, retail.customers).explain()
        checked = capsys.readouterr().out
        monkeypatch.setattr(rates, "one_row_per_key", lambda dimension, key: dimension)
        rates.risk_segments(retail.orders, retail.customers).explain()
        plain = capsys.readouterr().out
        assert "raise_error" in checked and "raise_error" not in plain
        assert checked.count("Exchange ") == plain.count("Exchange ") and checked.count("Sort ") == plain.count("Sort ")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
