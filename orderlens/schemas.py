"""Declared table schemas and the constraints that go with them."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    ArrayType,
)


def _struct(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


CUSTOMERS = _struct(
    ("customer_id", StringType()),
    ("name", StringType()),
    ("city", StringType()),
    ("city_tier", IntegerType()),
    ("signup_date", DateType()),
    ("acquisition_source", StringType()),
)
PRODUCTS = _struct(
    ("product_id", StringType()),
    ("product_name", StringType()),
    ("category", StringType()),
    ("price", DecimalType(12, 2)),
)
ORDERS = _struct(
    ("order_id", StringType()),
    ("customer_id", StringType()),
    ("product_id", StringType()),
    ("order_date", DateType()),
    ("quantity", IntegerType()),
    ("discount_pct", IntegerType()),
    ("payment_method", StringType()),
    ("rating", IntegerType()),
    ("returned", IntegerType()),
)

# The columns that make two order rows copies of one another.
DEDUP_KEY = ("customer_id", "product_id", "order_date", "quantity", "discount_pct", "payment_method")

# Key, mandatory columns, allowed values and ranges of each table.
PRIMARY_KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id"}
NOT_NULL = {
    "customers": ("customer_id", "name"),
    "products": ("product_id", "product_name", "price"),
    "orders": ("order_id", "customer_id", "product_id", "order_date", "quantity", "returned"),
}
DOMAINS = {
    "customers": {"city_tier": (1, 2), "acquisition_source": ("Ad", "Organic", "Referral", "Social")},
    "products": {"category": ("Haircare", "Skincare", "Babycare", "PersonalCare")},
    "orders": {"returned": (0, 1)},
}
# (low, high, low is allowed); None leaves a side open.
RANGES = {
    "customers": {},
    "products": {"price": (0, None, False)},
    "orders": {"quantity": (0, None, False), "discount_pct": (0, 100, True), "rating": (1, 5, True)},
}
FOREIGN_KEYS = {"orders": {"customer_id": "customers", "product_id": "products"}}

# Names of the fields of the findings document.
_PEAK = _struct(("month", StringType()), ("revenue_inr", DoubleType()))
FINDINGS = _struct(
    (
        "data",
        _struct(
            ("source_files", ArrayType(StringType())),
            ("raw_orders", LongType()),
            ("clean_orders", LongType()),
            ("duplicates_removed", LongType()),
            ("customers", LongType()),
            ("products", LongType()),
            ("period", _struct(("from", StringType()), ("to", StringType()))),
        ),
    ),
    (
        "revenue",
        _struct(
            ("raw_total_inr", DoubleType()),
            ("clean_total_inr", DoubleType()),
            ("duplicate_delta_inr", DoubleType()),
            ("avg_order_value_inr", DoubleType()),
        ),
    ),
    (
        "returns",
        _struct(
            ("overall_rate_pct", DoubleType()),
            ("returned_orders", LongType()),
            (
                "worst_product_by_revenue_lost",
                _struct(
                    ("product_id", StringType()),
                    ("product_name", StringType()),
                    ("revenue_lost_inr", DoubleType()),
                ),
            ),
        ),
    ),
    (
        "highest_risk_segment",
        _struct(
            ("payment_method", StringType()),
            ("city_tier", IntegerType()),
            ("orders", LongType()),
            ("return_rate_pct", DoubleType()),
        ),
    ),
    (
        "outliers",
        _struct(
            ("method", StringType()),
            ("q1", DoubleType()),
            ("q3", DoubleType()),
            ("upper_fence", DoubleType()),
            ("flagged_rows", LongType()),
            ("handling", StringType()),
            ("peak_month_all_orders", _PEAK),
            ("peak_month_without_outliers", _PEAK),
        ),
    ),
    (
        "correlations",
        _struct(
            ("discount_vs_returned", DoubleType()),
            ("rating_vs_returned", DoubleType()),
            ("quantity_vs_returned", DoubleType()),
            ("note", StringType()),
        ),
    ),
    (
        "segment_summary",
        _struct(
            ("low_value_customers", LongType()),
            ("mid_value_customers", LongType()),
            ("high_value_customers", LongType()),
        ),
    ),
    ("tables", ArrayType(StringType())),
)
