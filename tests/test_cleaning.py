import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orderlens.functions.coerce import to_number
from orderlens.functions.labels import clean_label, spend_tier
from orderlens.operators import cleaning
from orderlens.operators.enrich import order_value
from orderlens.schemas import DEDUP_KEY
from tests.conftest import as_dicts, retail_rows

TEXT = "order_id string, customer_id string, product_id string, order_date string, quantity string, " \
    "discount_pct string, payment_method string, rating string, returned string"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), TEXT)


def test_bad_cells_become_null(spark):
    cells = ["", " 12 ", "n/a", "12x", "12d", "1e3", "-4.5", "0x1F", "1,000", None, "."]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(to_number(F.col("c"))).collect()] == [
        None, 12.0, None, None, None, 1000.0, -4.5, None, None, None, None,
    ]
    assert [r[0] for r in df.select(to_number(F.col("c"), "int")).collect()] == [
        None, 12, None, None, None, 1000, None, None, None, None, None,
    ]


def test_labels_lose_white_space_of_any_kind(spark):
    labels = ["\tcard\n", " Card", "CARD ", "\x1cCaRd　", "two words ", "straße"]
    df = spark.createDataFrame([(x,) for x in labels], "c string")
    assert [r[0] for r in df.select(clean_label(F.col("c"))).collect()] == [x.strip().upper() for x in labels]


def test_first_row_of_a_key_wins(spark):
    df = raw(
        spark,
        ("O3", "C1", "P1", "2026-01-01", "1", "10", "card", "5", "1"),
        ("O1", "C1", "P1", "2026-01-01", "1", "10", "CARD ", "2", "0"),
        ("O2", "C1", "P1", "2026-01-01", "1", "10", "Card", "4", "1"),
    )
    (kept,) = as_dicts(cleaning.clean_orders(df))
    assert (kept["order_id"], kept["rating"], kept["returned"]) == ("O1", 2.0, 0)
    removed = cleaning.removed_copies(cleaning.typed_orders(df))
    assert sorted(r["order_id"] for r in removed.collect()) == ["O2", "O3"]


def test_order_of_cleaning_steps_decides_on_blank_and_zero(spark):
    df = raw(
        spark,
        ("O1", "C1", "P1", "2026-01-01", "1", "", "card", "5", "1"),
        ("O2", "C1", "P1", "2026-01-01", "1", "0", "card", "3", "1"),
    )
    assert cleaning.clean_orders(df).count() == 2
    assert cleaning.clean_orders_fill_first(df).count() == 1


def test_nulls_in_the_key_are_equal(spark):
    df = raw(
        spark,
        ("O1", "C1", "P1", "2026-01-01", "1", None, "card", "5", "1"),
        ("O2", "C1", "P1", "2026-01-01", "1", "", "card", "3", "1"),
    )
    assert cleaning.clean_orders(df).count() == 1


def test_rating_policies(spark):
    df = raw(
        spark,
        *[(f"O{i}", f"C{i}", "P1", "2026-01-01", "1", "0", "card", r, "1") for i, r in enumerate(["1", "4", "5", ""])],
    )
    assert sorted(r["rating"] for r in cleaning.clean_orders(df).collect()) == [1.0, 4.0, 4.0, 5.0]
    kept = cleaning.clean_orders(df, rating_policy="keep_null")
    assert kept.filter("rating IS NULL").count() == 1
    with pytest.raises(ValueError):
        cleaning.fill_missing(df, "mean")


def test_unreadable_date_is_an_error(spark):
    df = raw(spark, ("O1", "C1", "P1", "01/02/2026", "1", "0", "card", "5", "1"))
    with pytest.raises(Exception, match="parse|PARSE"):
        cleaning.clean_orders(df, rating_policy="keep_null").collect()


def test_raw_minus_clean_is_the_value_of_the_removed_rows(retail):
    typed = cleaning.typed_orders(retail.orders)
    valued = order_value(typed, retail.products, how="left")
    (whole,) = as_dicts(cleaning.reconcile(valued, "order_value"))
    removed = order_value(cleaning.removed_copies(typed), retail.products, how="left")
    worth = removed.agg(F.sum("order_value")).first()[0]
    assert whole["removed_rows"] == 5
    assert whole["delta"] == float(worth) == pytest.approx(whole["raw_total"] - whole["clean_total"])


def test_value_of_fractional_quantities_is_exact(spark):
    orders = spark.createDataFrame([("O1", "P1", 2.5, 12.5, 1), ("O2", "P1", 1.0, None, 0)],
                                   "order_id string, product_id string, quantity double, discount_pct double, returned int")
    products = spark.createDataFrame([("P1", "x", "y", Decimal("9.99"))],
                                     "product_id string, product_name string, category string, price decimal(12,2)")
    values = {r["order_id"]: r["order_value"] for r in order_value(orders, products).collect()}
    assert values == {"O1": Decimal("21.853125"), "O2": Decimal("9.99")}


def test_spend_tiers_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1200.0, 1200.01, 2500.0, 2500.01, -1.0, None]], "v double")
    assert [r[0] for r in df.select(spend_tier(F.col("v"))).collect()] == [
        "Low value", "Low value", "Mid value", "Mid value", "High value", None, None,
    ]


def test_keep_first_agrees_with_python(retail):
    orders, _, _ = retail_rows()
    seen, kept = set(), []
    for o in orders:
        key = (o[1], o[2], o[3], o[4], o[5], o[6].strip().upper())
        if key not in seen:
            seen.add(key)
            kept.append(o[0])
    found = cleaning.keep_first(cleaning.typed_orders(retail.orders), DEDUP_KEY)
    assert sorted(r["order_id"] for r in found.collect()) == sorted(kept)
    assert cleaning.count_copies(cleaning.typed_orders(retail.orders)).first()[0] == len(orders) - len(kept)
    assert isinstance(found.first()["order_date"], dt.date)


def tied_rows(spark):
    """Copies that agree in key and id, ids that are missing, and rows of their own."""
    rows = []
    for i in range(60):
        order = None if i % 7 == 0 else f"O{i % 9}"
        rows.append((order, f"C{i % 4}", None if i % 5 == 0 else "P1", "2026-01-01", "1", "" if i % 3 else "0", " Card", str(i % 5 + 1), str(i % 2)))
    return raw(spark, *rows).repartition(3)


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_clean_orders_reads_its_rows_once_and_keeps_what_keep_first_keeps(spark):
    df = tied_rows(spark)
    kept = cleaning.clean_orders(df, rating_policy="keep_null")
    want = cleaning.fill_missing(cleaning.keep_first(cleaning.typed_orders(df)), "keep_null")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert reads(kept) == reads(df) == 1


def test_fill_first_reads_its_rows_once_and_keeps_what_keep_first_keeps(spark):
    df = tied_rows(spark)
    kept = cleaning.clean_orders_fill_first(df)
    want = cleaning.keep_first(cleaning.fill_missing(cleaning.typed_orders(df), "keep_null"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert reads(kept) == reads(df) == 1
