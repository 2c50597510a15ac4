"""The nine reports against a plain Python evaluation of the same rows."""

from collections import defaultdict

import pytest

from orderlens.functions.labels import DISCOUNT_BUCKETS
from orderlens.plans import reports
from tests.conftest import as_dicts, retail_rows


@pytest.fixture(scope="module")
def joined():
    orders, products, customers = retail_rows()
    by_product = {p[0]: p for p in products}
    by_customer = {c[0]: c for c in customers}
    rows = []
    for o in orders:
        p, c = by_product[o[2]], by_customer[o[1]]
        rows.append(
            {
                "customer_id": o[1],
                "name": c[1],
                "city": c[2],
                "acquisition_source": c[5],
                "product_id": o[2],
                "product_name": p[1],
                "category": p[2],
                "price": p[3],
                "quantity": o[4],
                "discount": o[5],
                "payment": o[6].strip(" ").upper(),
                "month": o[3].strftime("%Y-%m"),
                "returned": o[8],
                "value": o[4] * p[3] * (1 - (o[5] or 0) / 100),
            }
        )
    return rows


def grouped(rows, key):
    groups = defaultdict(list)
    for row in rows:
        groups[key(row)].append(row)
    return groups


def measures(rows):
    n, returned, total = len(rows), sum(r["returned"] for r in rows), sum(r["value"] for r in rows)
    return {
        "total_orders": n,
        "returned_orders": returned,
        "return_rate_pct": round(100 * returned / n, 2),
        "revenue": round(total, 2),
        "total_revenue": round(total, 2),
        "avg_order_value": round(total / n, 2),
        "customers": len({r["customer_id"] for r in rows}),
        "revenue_per_customer": round(total / len({r["customer_id"] for r in rows}), 2),
        "units_sold": sum(r["quantity"] for r in rows),
        "revenue_lost_to_returns": round(sum(r["value"] for r in rows if r["returned"]), 2),
    }


def check(df, rows, key, key_columns):
    found = as_dicts(df)
    expected = grouped(rows, key)
    assert len(found) == len(expected)
    for row in found:
        want = measures(expected[tuple(row[k] for k in key_columns)])
        for name, value in row.items():
            if name in want:
                assert value == pytest.approx(want[name], abs=0.011), (row, name)
    return found


def test_headline(retail, joined):
    (row,) = as_dicts(reports.headline(retail.orders, retail.products))
    want = measures(joined)
    assert row == pytest.approx({k: want[k] for k in row}, abs=0.011)


def test_category(retail, joined):
    found = check(
        reports.returns_by_category(retail.orders, retail.products), joined, lambda r: (r["category"],), ["category"]
    )
    assert [r["return_rate_pct"] for r in found] == sorted((r["return_rate_pct"] for r in found), reverse=True)


def test_payment_trims_spaces_only(retail, joined):
    found = check(
        reports.value_by_payment(retail.orders, retail.products), joined, lambda r: (r["payment"],), ["payment_method"]
    )
    assert {"COD", "COD\n", "CARD"} <= {r["payment_method"] for r in found}


def test_top_returning_customers(retail, joined):
    found = as_dicts(reports.top_returning_customers(retail.orders, retail.customers, min_orders=3, top=4))
    want = [
        {"customer_id": k, **measures(v)} for k, v in grouped(joined, lambda r: r["customer_id"]).items() if len(v) >= 3
    ]
    want.sort(key=lambda r: (-r["return_rate_pct"], -r["total_orders"], r["customer_id"]))
    assert [r["customer_id"] for r in found] == [r["customer_id"] for r in want[:4]]
    assert [r["return_rate_pct"] for r in found] == [r["return_rate_pct"] for r in want[:4]]


def test_city_counts_only_customers_with_orders(retail, joined):
    found = check(
        reports.city_performance(retail.orders, retail.products, retail.customers),
        joined,
        lambda r: (r["city"],),
        ["city"],
    )
    assert sum(r["customers"] for r in found) == len({r["customer_id"] for r in joined}) < 12


def test_channel(retail, joined):
    check(
        reports.channel_roi(retail.orders, retail.products, retail.customers),
        joined,
        lambda r: (r["acquisition_source"],),
        ["acquisition_source"],
    )


def test_product_loss(retail, joined):
    found = check(
        reports.product_loss(retail.orders, retail.products), joined, lambda r: (r["product_id"],), ["product_id"]
    )
    order = [(-r["return_rate_pct"], -r["revenue_lost_to_returns"], r["product_id"]) for r in found]
    assert order == sorted(order)


def test_discount_buckets(retail, joined):
    def bucket(r):
        d = r["discount"] or 0
        return (DISCOUNT_BUCKETS[0 if d == 0 else 1 if d <= 10 else 2 if d <= 20 else 3],)

    check(reports.returns_by_discount(retail.orders, retail.products), joined, bucket, ["discount_bucket"])


def test_monthly(retail, joined):
    found = check(
        reports.monthly_trend(retail.orders, retail.products), joined, lambda r: (r["month"],), ["order_month"]
    )
    assert [r["order_month"] for r in found] == sorted(r["order_month"] for r in found)


def test_no_rows(retail):
    empty = retail.orders.limit(0)
    (row,) = as_dicts(reports.headline(empty, retail.products))
    assert row["total_orders"] == 0 and row["return_rate_pct"] is None
    assert as_dicts(reports.returns_by_category(empty, retail.products)) == []
