"""Findings, segments, rates, charts and briefs against plain Python over the same rows."""

import json
import re
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens import schemas
from orderlens.functions.leaves import numeric_leaves
from orderlens.operators import correlation, factcheck, outliers, rates, segments
from orderlens.operators.cleaning import clean_orders
from orderlens.operators.skew import NO_HOT_KEYS, HotKeys
from orderlens.session import stage
from orderlens.operators.enrich import enrich_orders
from orderlens.plans import briefs, charts, findings
from orderlens.sources.tables import read_findings, write_briefs, write_findings
from tests.conftest import as_dicts, retail_rows

TIERS = (3000, 6000)


@pytest.fixture(scope="module")
def analysis(retail):
    return findings.analyse(retail.orders, retail.products, retail.customers)


@pytest.fixture(scope="module")
def document(analysis):
    """The document with its side tables put in their places."""
    whole = json.loads(findings.findings_document(analysis, ["orders"], TIERS).toJSON().first())
    whole["monthly"], whole["outliers"]["order_ids"] = {}, []
    assert whole["tables"] == list(findings.TABLES)
    for r in findings.findings_tables(analysis).collect():
        if r["section"] == findings.MONTHLY:
            whole["monthly"][r["label"]] = r["value"]
        elif r["section"] == findings.FLAGGED:
            whole["outliers"]["order_ids"].append(r["label"])
        else:
            whole["returns"].setdefault(r["section"].split(".")[1], {}).setdefault(r["label"], {})[r["metric"]] = r["value"]
    whole["outliers"]["order_ids"].sort()
    return whole


@pytest.fixture(scope="module")
def rows():
    orders, products, customers = retail_rows()
    by_product = {p[0]: p for p in products}
    by_customer = {c[0]: c for c in customers}
    seen, kept = set(), []
    for o in orders:
        label = o[6].strip().upper()
        key = (o[1], o[2], o[3], o[4], o[5], label)
        if key in seen:
            continue
        seen.add(key)
        p, c = by_product[o[2]], by_customer[o[1]]
        kept.append(
            {
                "order_id": o[0], "customer_id": o[1], "product_id": o[2], "month": o[3].strftime("%Y-%m"),
                "quantity": o[4], "discount_pct": o[5] or 0, "payment_method": label, "rating": o[7], "returned": o[8],
                "category": p[2], "city": c[2], "city_tier": c[3], "acquisition_source": c[5],
                "value": o[4] * p[3] * (1 - (o[5] or 0) / 100), "product_name": p[1],
            }
        )
    median = float(np.median([r["rating"] for r in kept if r["rating"] is not None]))
    for r in kept:
        r["rating"] = median if r["rating"] is None else r["rating"]
        r["outlier"] = r["quantity"] > 5
    return kept


def rate_table(rows, *keys):
    groups = defaultdict(list)
    for r in rows:
        groups[tuple(r[k] for k in keys)].append(r["returned"])
    return {k: (len(v), round(100 * sum(v) / len(v), 2)) for k, v in groups.items()}


def monthly(rows):
    sums = defaultdict(float)
    for r in rows:
        sums[r["month"]] += r["value"]
    return {k: round(v, 2) for k, v in sums.items()}


def test_data_and_revenue(document, rows):
    data = document["data"]
    assert (data["raw_orders"], data["clean_orders"], data["duplicates_removed"]) == (125, len(rows), 125 - len(rows))
    assert data["customers"] == len({r["customer_id"] for r in rows})
    assert data["products"] == len({r["product_id"] for r in rows})
    total = sum(r["value"] for r in rows)
    assert document["revenue"]["clean_total_inr"] == pytest.approx(total, abs=0.006)
    assert document["revenue"]["avg_order_value_inr"] == pytest.approx(total / len(rows), abs=0.006)
    raw, clean = document["revenue"]["raw_total_inr"], document["revenue"]["clean_total_inr"]
    assert document["revenue"]["duplicate_delta_inr"] == pytest.approx(raw - clean)


def test_rates(document, rows):
    for name in ("payment_method", "category", "city", "acquisition_source"):
        found = {(k,): (v["orders"], v["return_rate_pct"]) for k, v in document["returns"][f"by_{name}"].items()}
        assert found == rate_table(rows, name)


def test_risk_and_worst_product(document, rows):
    table = rate_table(rows, "payment_method", "city_tier")
    best = min(table, key=lambda k: (-table[k][1], k))
    risk = document["highest_risk_segment"]
    assert (risk["payment_method"], risk["city_tier"]) == best
    assert (risk["orders"], risk["return_rate_pct"]) == table[best]
    lost = defaultdict(float)
    for r in rows:
        if r["returned"]:
            lost[r["product_id"]] += r["value"]
    worst = document["returns"]["worst_product_by_revenue_lost"]
    assert worst["product_id"] == max(lost, key=lost.get)
    assert worst["revenue_lost_inr"] == pytest.approx(max(lost.values()), abs=0.006)


def test_outliers_and_months(document, rows):
    out = document["outliers"]
    q1, q3 = np.quantile([r["quantity"] for r in rows], [0.25, 0.75])
    assert (out["q1"], out["q3"], out["upper_fence"]) == (q1, q3, q3 + 1.5 * (q3 - q1))
    assert out["order_ids"] == [r["order_id"] for r in rows if r["outlier"]] == ["O017", "O060"]
    kept = monthly([r for r in rows if not r["outlier"]])
    assert document["monthly"] == pytest.approx(kept, abs=0.011)
    assert out["peak_month_without_outliers"]["month"] == max(kept, key=kept.get)
    everything = monthly(rows)
    assert out["peak_month_all_orders"]["month"] == max(everything, key=everything.get)


def test_correlations(document, rows):
    for name in ("discount_pct", "rating", "quantity"):
        r = np.corrcoef([x[name] for x in rows], [x["returned"] for x in rows])[0, 1]
        assert document["correlations"][f"{name.split('_')[0]}_vs_returned"] == pytest.approx(r, abs=0.0006)


def test_segments(document, analysis, retail, rows):
    spend = defaultdict(float)
    for r in rows:
        spend[r["customer_id"]] += r["value"]
    counts = {
        "low_value_customers": sum(v <= 3000 for v in spend.values()),
        "mid_value_customers": sum(3000 < v <= 6000 for v in spend.values()),
        "high_value_customers": sum(v > 6000 for v in spend.values()),
    }
    assert document["segment_summary"] == counts
    per_customer = as_dicts(segments.customer_segments(analysis.orders, retail.customers, TIERS))
    assert {r["customer_id"]: r["spend"] for r in per_customer} == pytest.approx(spend, abs=0.006)
    summary = as_dicts(segments.segment_summary(segments.customer_rollup(analysis.orders), TIERS))
    assert sum(r["customers"] for r in summary) == len(spend)
    top = as_dicts(segments.repeat_returners(segments.customer_rollup(analysis.orders), retail.customers, top=3))
    assert len(top) == 3 and [-r["return_rate"] for r in top] == sorted(-r["return_rate"] for r in top)


def many(spark, n):
    """``n`` orders of as many customers in as many cities, every fifth with a large quantity."""
    ids = spark.range(n)
    orders = ids.selectExpr(
        "concat('O', id) as order_id", "concat('C', id) as customer_id", "concat('P', id % 3) as product_id", "date'2026-01-05' as order_date",
        "if(id % 5 = 0, 50, 1) as quantity", "0 as discount_pct", "'Card' as payment_method", "3 as rating", "0 as returned",
    )
    products = spark.createDataFrame([(f"P{i}", f"n{i}", "c", Decimal("2.00")) for i in range(3)], schemas.PRODUCTS)
    customers = ids.selectExpr("concat('C', id) as customer_id", "'n' as name", "concat('city', id) as city", "1 as city_tier", "date'2026-01-01' as signup_date", "'Ad' as acquisition_source")
    return orders, products, customers


def test_side_tables_hold_all_labels_and_all_flagged_orders(spark):
    analysis = findings.analyse(*many(spark, 10_500))
    sizes = {r["section"]: r["count"] for r in findings.findings_tables(analysis).groupBy("section").count().collect()}
    assert sizes["returns.by_city"] == 21_000 and sizes[findings.FLAGGED] == 2_100
    assert findings.findings_document(analysis).select("outliers.flagged_rows").first()[0] == 2_100


def test_a_repeated_key_of_a_dimension_is_an_error(spark):
    orders, products, customers = many(spark, 4)
    for tables in ((orders, products.union(products.limit(1)), customers), (orders, products, customers.union(customers.limit(1)))):
        with pytest.raises(Exception, match="occurs more than once in a dimension"):
            findings.analyse(*tables)


def test_copies_that_differ_in_quantity_count_with_their_own_value(spark):
    orders, products, customers = many(spark, 2)
    orders = orders.limit(1).selectExpr("* except (order_id, quantity)", "explode(array(struct('A' as order_id, 5 as quantity), struct('B' as order_id, 15 as quantity))) as x")
    orders = orders.selectExpr("* except (x)", "x.order_id", "x.quantity").select(*schemas.ORDERS.names)
    analysis = findings.analyse(orders, products, customers, ("customer_id", "product_id", "order_date"))
    revenue = findings.findings_document(analysis).select("revenue.*").first()
    assert (revenue["raw_total_inr"], revenue["clean_total_inr"], revenue["duplicate_delta_inr"]) == (40.0, 10.0, 30.0)
    with pytest.raises(ValueError, match="product_id"):
        findings.analyse(orders, products, customers, ("customer_id", "order_date"))


def test_months_with_only_flagged_orders_are_left_out(spark):
    cells = spark.createDataFrame([("2026-01", True, 5.0), ("2026-02", False, 3.0), ("2026-02", True, 4.0)], "month string, is_outlier boolean, amount double")
    rows = {r["month"]: r["revenue_without_outliers"] for r in findings.monthly_of(cells).collect()}
    assert rows == {"2026-01": None, "2026-02": 3.0}


def test_document_roundtrip(spark, analysis, document, tmp_path):
    one = findings.findings_document(analysis, ["orders"], TIERS)
    assert one.schema.simpleString() == schemas.FINDINGS.simpleString()
    write_findings(one, str(tmp_path / "findings"))
    back = read_findings(spark, str(tmp_path / "findings"))
    assert back.toJSON().first() == one.toJSON().first()
    assert numeric_leaves(back).count() == numeric_leaves(one).count() > 20


def test_rates_by_dimension_agrees_with_the_document(retail, document):
    cleaned = clean_orders(retail.orders)
    found = defaultdict(dict)
    for r in rates.rates_by_dimension(cleaned, retail.products, retail.customers).collect():
        found[r["dimension"]][r["label"]] = {"orders": r["orders"], "return_rate_pct": r["return_rate_pct"]}
    for name in ("payment_method", "category", "city", "acquisition_source"):
        assert found[name] == document["returns"][f"by_{name}"]
    assert found["all"]["all"]["return_rate_pct"] == document["returns"]["overall_rate_pct"]
    ranked = as_dicts(rates.risk_segments(cleaned, retail.customers))
    assert {k: ranked[0][k] for k in ranked[0]} == document["highest_risk_segment"]


def test_charts(retail, document):
    cleaned = clean_orders(retail.orders)
    bars = as_dicts(charts.rate_by_payment(cleaned))
    by_method = document["returns"]["by_payment_method"]
    assert {b["payment_method"]: b["return_rate_pct"] for b in bars} == {
        k: v["return_rate_pct"] for k, v in by_method.items()
    }
    top = max(b["return_rate_pct"] for b in bars)
    assert all(b["is_highest"] == (b["return_rate_pct"] == top) for b in bars)
    line = as_dicts(charts.monthly_revenue(cleaned, retail.products))
    assert sum(r["revenue"] for r in line) == pytest.approx(document["revenue"]["clean_total_inr"], abs=0.05)


def test_correlation_of_constant_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 5, None), (2, 4.0, 5, None), (3, 5.0, 5, None), (None, 9.0, 5, None)],
                               "a int, b double, c int, d int")
    r = {(x["var_x"], x["var_y"]): x["r"] for x in correlation.correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert r[("a", "b")] == r[("b", "a")] == round(np.corrcoef([1, 2, 3], [2, 4, 5])[0, 1], 3)
    assert r[("a", "a")] == 1.0
    assert all(r[("c", other)] is None or np.isnan(r[("c", other)]) for other in "abc")
    assert r[("a", "d")] is None


def test_peak_takes_the_earliest_of_equal_months(spark):
    df = spark.createDataFrame([("2026-02", 5.0), ("2026-01", 5.0), ("2026-03", None)], "month string, v double")
    assert rates.peak(df, "v").first()["month"] == "2026-01"


def test_briefs_state_their_own_figures(spark, analysis, document, tmp_path):
    figures = briefs.brief_figures(analysis.cells, analysis.orders, "city")
    texts = briefs.render_briefs(figures, "city").cache()
    stated = briefs.stated_figures(figures, "city")
    checked = factcheck.own_figures_check(texts, stated)
    found = as_dicts(checked)
    assert len(found) == 3 * len(briefs.HEADLINE) and all(r["ok"] for r in found)
    scores = factcheck.own_figures_score(checked)
    assert {(r["matched"], r["total"]) for r in scores.collect()} == {(7, 7)}
    whole = briefs.brief_figures(*(df.withColumn("company", F.lit("All")) for df in (analysis.cells, analysis.orders)), "company")
    brief = briefs.render_briefs(whole, "company")
    leaves = findings.figures(analysis, findings.findings_document(analysis, [], TIERS))
    assert as_dicts(factcheck.unsupported_numbers(brief, leaves)) == []
    write_briefs(texts, scores, str(tmp_path / "briefs"))
    stored = spark.read.parquet(str(tmp_path / "briefs"))
    assert stored.filter("matched = total AND generated_at IS NOT NULL").count() == 3


def test_enrichment_keeps_every_row(retail):
    enriched = enrich_orders(retail.orders, retail.products, retail.customers)
    assert enriched.count() == retail.orders.count()
    assert outliers.flag_outliers(enriched, "quantity").count() == 125


def analysis_plan(spark, retail, monkeypatch, **given):
    """The analysis, and the plan of its staged orders where no table is broadcast."""
    plans = {}

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label)

    monkeypatch.setattr(findings, "stage", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return findings.analyse(retail.orders, retail.products, retail.customers, **given), plans["enriched-orders"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orders_are_shuffled_by_customer_once_and_not_sorted_for_many_products(spark, retail, monkeypatch):
    monkeypatch.setattr(findings, "MANY_PRODUCTS", 3)
    got, plan = analysis_plan(spark, retail, monkeypatch, hot_products=NO_HOT_KEYS, hot_customers=NO_HOT_KEYS)
    by_key = r"hashpartitioning\(customer_id#\d+, product_id"
    assert plan.count("REPARTITION_BY_NUM") == 1 and not re.search(by_key, plan)
    assert "ShuffledHashJoin [product_id" in plan and "SortMergeJoin [product_id" not in plan
    hot, other = analysis_plan(spark, retail, monkeypatch, hot_products=NO_HOT_KEYS, hot_customers=HotKeys(("C01",), (0.5,)))
    assert "REPARTITION_BY_NUM" not in other and re.search(by_key, other)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got.orders) == rows(hot.orders) and rows(got.cells) == rows(hot.cells)
