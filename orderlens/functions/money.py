"""Money and rates.

Money is exact: whole quantities, percentages and cents are multiplied as integers and
summed as integers or decimals, so sums do not depend on the order of rows. It becomes
double only in the last projection of a report.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

QUANTITY = "decimal(12,2)"
PRICE = "decimal(12,2)"
PERCENT = "decimal(5,2)"
CENTS = "price_cents"
PER_CENT = Decimal("0.01")
PER_CENT_OF_CENT = Decimal("0.0001")


def _whole(df: DataFrame) -> bool:
    """Are quantity and discount integers? Then integer arithmetic is exact."""
    return all(isinstance(df.schema[c].dataType, IntegralType) for c in ("quantity", "discount_pct"))


def net_units(orders: DataFrame) -> Column:
    """Quantity after discount, in hundredths; a missing discount counts as none."""
    if _whole(orders):
        return F.col("quantity").cast("long") * (F.lit(100) - F.coalesce("discount_pct", F.lit(0))).cast("long")
    percent = F.coalesce(F.col("discount_pct").cast(PERCENT), F.lit(0).cast(PERCENT))
    return F.col("quantity").cast(QUANTITY) * (F.lit(100).cast(PERCENT) - percent)


def with_cents(products: DataFrame) -> DataFrame:
    """Products with their price in whole cents too, computed once per product."""
    return products.withColumn(CENTS, (F.col("price") * 100).cast("long"))


def line_value(joined: DataFrame) -> Column:
    """``quantity * price * (1 - discount_pct / 100)`` of rows joined to ``with_cents``."""
    if _whole(joined):
        exact = (net_units(joined) * F.col(CENTS)).cast("decimal(18,0)")
        return exact * F.lit(PER_CENT_OF_CENT)
    return net_units(joined) * F.lit(PER_CENT) * F.col("price").cast(PRICE)


def priced(units: Column, price: Column) -> Column:
    """Price a sum of net units; equal to summing the line values of one product."""
    return units.cast("decimal(24,4)") * (price.cast(PRICE) * F.lit(PER_CENT)).cast("decimal(13,4)")


def money(amount: Column) -> Column:
    return F.round(amount, 2).cast("double")


def mean_money(amount: Column, n: Column) -> Column:
    return F.round(F.try_divide(amount.cast("double"), n), 2)


def rate_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``100 * part / whole``; NULL for an empty group."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)
