"""Known results on the original retail rows.

The rows are not part of this repository: name their folder (orders.csv, products.csv and
customers.csv, without headers) in ``ORDERLENS_GOLDEN_DIR``.
"""

import json
import os

import pytest
from pyspark.sql import functions as F

from orderlens.operators import factcheck, quality
from orderlens.operators.cleaning import clean_orders, clean_orders_fill_first, removed_copies, typed_orders
from orderlens.plans import briefs, findings, reports
from orderlens.sources.tables import read_retail_csv

FOLDER = os.environ.get("ORDERLENS_GOLDEN_DIR", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="ORDERLENS_GOLDEN_DIR is not set")

# The published results of the nine reports.
HEADLINE = [(180, 44, 99860.2, 554.78, 45, 25.0)]
CATEGORY = [
    ("Skincare", 60, 19, 31.67, 27346.0),
    ("Haircare", 54, 14, 25.93, 44956.1),
    ("Babycare", 30, 7, 23.33, 16805.0),
    ("PersonalCare", 36, 5, 13.89, 10753.1),
]
PAYMENT = [
    ("COD", 55, 714.64, 39305.2, 43.64),
    ("UPI", 55, 488.42, 26863.2, 20.0),
    ("CARD", 70, 481.31, 33691.8, 14.29),
]
TOP_CUSTOMERS = [
    ("C028", 5, 4, 80.0),
    ("C025", 3, 2, 66.67),
    ("C024", 7, 4, 57.14),
    ("C029", 6, 3, 50.0),
    ("C041", 4, 2, 50.0),
    ("C042", 7, 3, 42.86),
    ("C026", 5, 2, 40.0),
    ("C035", 5, 2, 40.0),
    ("C008", 9, 3, 33.33),
    ("C010", 9, 3, 33.33),
]
CITY = [
    ("Bangalore", 9, 33, 28138.4, 24.24),
    ("Lucknow", 11, 49, 27523.3, 30.61),
    ("Mumbai", 12, 56, 25143.4, 17.86),
    ("Delhi", 6, 23, 10151.7, 17.39),
    ("Jaipur", 6, 19, 8903.4, 42.11),
]
CHANNEL = [
    ("Ad", 53, 14, 36674.7, 2619.62, 32.08),
    ("Organic", 62, 13, 32435.9, 2495.07, 17.74),
    ("Social", 35, 9, 15798.3, 1755.37, 28.57),
    ("Referral", 30, 8, 14951.3, 1868.91, 23.33),
]
PRODUCT = [
    ("P12", 249.0, 6, 4, 66.67, 1319.7),
    ("P04", 649.0, 7, 3, 42.86, 1557.6),
    ("P08", 229.0, 17, 6, 35.29, 1763.3),
    ("P07", 699.0, 12, 4, 33.33, 3005.7),
    ("P10", 449.0, 16, 5, 31.25, 3771.6),
    ("P16", 199.0, 10, 3, 30.0, 477.6),
    ("P06", 249.0, 7, 2, 28.57, 697.2),
    ("P02", 399.0, 11, 3, 27.27, 1795.5),
    ("P03", 599.0, 15, 4, 26.67, 3594.0),
    ("P09", 299.0, 8, 2, 25.0, 448.5),
    ("P05", 349.0, 10, 2, 20.0, 837.6),
    ("P01", 349.0, 11, 2, 18.18, 593.3),
    ("P13", 279.0, 7, 1, 14.29, 558.0),
    ("P14", 199.0, 14, 2, 14.29, 298.5),
    ("P11", 299.0, 17, 2, 11.76, 8073.0),
    ("P15", 349.0, 12, 0, 0.0, 0.0),
]
DISCOUNT = [
    ("1. No discount (0%)", 38, 11, 28.95, 1023.61),
    ("2. Low (1-10%)", 41, 11, 26.83, 459.02),
    ("3. Medium (11-20%)", 41, 13, 31.71, 433.35),
    ("4. High (21-30%)", 60, 10, 16.67, 406.27),
]
MONTH = [
    ("2026-01", 24, 91, 29582.1, 20.83),
    ("2026-02", 32, 42, 13464.6, 21.88),
    ("2026-03", 38, 66, 20731.1, 36.84),
    ("2026-04", 27, 32, 9495.3, 37.04),
    ("2026-05", 33, 49, 14727.4, 15.15),
    ("2026-06", 26, 40, 11859.7, 15.38),
]

# The published findings.
FINDINGS = {
    "data.raw_orders": 180,
    "data.clean_orders": 175,
    "data.duplicates_removed": 5,
    "data.customers": 44,
    "data.products": 16,
    "revenue.raw_total_inr": 99860.2,
    "revenue.clean_total_inr": 97358.3,
    "revenue.duplicate_delta_inr": 2501.9,
    "revenue.avg_order_value_inr": 556.33,
    "returns.overall_rate_pct": 25.14,
    "returns.returned_orders": 44,
    "returns.by_payment_method.CARD.return_rate_pct": 14.71,
    "returns.by_payment_method.COD.return_rate_pct": 44.44,
    "returns.by_payment_method.UPI.return_rate_pct": 18.87,
    "returns.by_category.Skincare.return_rate_pct": 30.51,
    "returns.by_city.Jaipur.return_rate_pct": 42.11,
    "returns.by_acquisition_source.Ad.return_rate_pct": 32.0,
    "returns.worst_product_by_revenue_lost.revenue_lost_inr": 8073.0,
    "highest_risk_segment.city_tier": 2,
    "highest_risk_segment.orders": 22,
    "highest_risk_segment.return_rate_pct": 54.55,
    "outliers.q1": 1.0,
    "outliers.q3": 2.0,
    "outliers.upper_fence": 3.5,
    "outliers.flagged_rows": 2,
    "outliers.peak_month_all_orders.revenue_inr": 29582.1,
    "outliers.peak_month_without_outliers.revenue_inr": 20318.9,
    "correlations.discount_vs_returned": -0.088,
    "correlations.rating_vs_returned": -0.101,
    "correlations.quantity_vs_returned": 0.041,
    "monthly.2026-01": 11637.1,
    "monthly.2026-02": 13195.5,
    "monthly.2026-03": 20318.9,
    "monthly.2026-04": 9495.3,
    "monthly.2026-05": 13151.1,
    "monthly.2026-06": 11615.4,
    "segment_summary.low_value_customers": 14,
    "segment_summary.mid_value_customers": 19,
    "segment_summary.high_value_customers": 11,
}


@pytest.fixture(scope="module")
def tables(spark):
    return read_retail_csv(spark, FOLDER)


@pytest.fixture(scope="module")
def analysis(spark):
    raw = read_retail_csv(spark, FOLDER, raw_orders_as_text=True)
    return findings.analyse(*raw)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_reports(tables):
    o, p, c = tables
    assert rows(reports.headline(o, p)) == HEADLINE
    assert rows(reports.returns_by_category(o, p)) == CATEGORY
    assert rows(reports.value_by_payment(o, p)) == PAYMENT
    top = reports.top_returning_customers(o, c)
    assert rows(top, "customer_id", "total_orders", "returned_orders", "return_rate_pct") == TOP_CUSTOMERS
    assert rows(reports.city_performance(o, p, c)) == CITY
    assert rows(reports.channel_roi(o, p, c)) == CHANNEL
    assert rows(reports.product_loss(o, p).drop("product_name", "category")) == PRODUCT
    assert rows(reports.returns_by_discount(o, p)) == DISCOUNT
    assert rows(reports.monthly_trend(o, p)) == MONTH


def test_checks_after_loading(tables):
    o, p, c = tables
    counts = rows(quality.row_counts({"customers": c, "products": p, "orders": o}))
    assert counts == [("customers", 45), ("products", 16), ("orders", 180)]
    assert [n for _, n in rows(quality.null_counts(o, ["discount_pct", "rating"]))] == [12, 15]
    assert quality.orphans(o, c, "customer_id", "customer_id", "x").first()["problems"] == 0
    assert rows(quality.value_counts(o, "payment_method")) == [
        ("Card", 56), ("UPI", 53), ("COD", 50), ("CARD", 7), ("card", 7), ("cod", 5), ("upi", 2),
    ]
    for name, df in zip(("orders", "products", "customers"), tables):
        assert {n for _, n in rows(quality.count_violations(df, quality.declared_checks(name)))} == {0}


def test_cleaning(tables):
    typed = typed_orders(tables.orders)
    assert sorted(r["order_id"] for r in removed_copies(typed).collect()) == [f"O{i:04}" for i in range(176, 181)]
    assert clean_orders(tables.orders).count() == clean_orders_fill_first(tables.orders).count() == 175


def test_findings(analysis):
    document = findings.findings_document(analysis)
    found = {r["path"]: r["value"] for r in findings.figures(analysis, document).collect()}
    assert {k: found[k] for k in FINDINGS} == FINDINGS
    out = json.loads(document.toJSON().first())["outliers"]
    flagged = findings.findings_tables(analysis).filter(f"section = '{findings.FLAGGED}'")
    assert sorted(r["label"] for r in flagged.collect()) == ["O0011", "O0098"]
    assert out["peak_month_all_orders"]["month"] == "2026-01"
    assert out["peak_month_without_outliers"]["month"] == "2026-03"


def test_brief_is_supported(analysis):
    document = findings.findings_document(analysis)
    figures = briefs.brief_figures(*(df.withColumn("company", F.lit("The company")) for df in (analysis.cells, analysis.orders)), "company")
    text = briefs.render_briefs(figures, "company")
    headline = briefs.stated_figures(figures, "company").select("label", "value")
    score = factcheck.headline_score(text, headline).first()
    assert (score["matched"], score["total"]) == (7, 7)
    assert factcheck.unsupported_numbers(text, findings.figures(analysis, document)).count() == 0
