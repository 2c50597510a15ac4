import datetime as dt

import pytest

from orderlens import schemas
from orderlens.session import build_session, drop_staged
from orderlens.sources.tables import Retail


@pytest.fixture(scope="session")
def spark():
    session = build_session("orderlens-tests", 4, shuffle_partitions=4)
    yield session
    drop_staged(session)
    session.stop()


def retail_rows():
    """Small retail tables by rule: messy labels, blanks, copies, two bulk orders, an idle customer."""
    sources, cities = ("Ad", "Organic", "Referral", "Social"), ("Delhi", "Jaipur", "Mumbai")
    customers = [
        (f"C{i:02}", f"Name{i}", cities[i % 3], 1 + i % 2, dt.date(2026, 1, 1 + i), sources[i % 4]) for i in range(12)
    ]
    kinds = ("Haircare", "Skincare", "Babycare", "PersonalCare")
    products = [(f"P{i}", f"Product {i}", kinds[i % 4], 99.5 + 50 * i) for i in range(7)]
    spellings = ("CARD", " card", "Card ", "COD", "cod\n", "\tUPI", "upi")
    orders = []
    for i in range(120):
        orders.append(
            (
                f"O{i:03}",
                f"C{(i * 7 + i // 5) % 11:02}",
                f"P{(i * 5 + i // 7) % 7}",
                dt.date(2026, 1 + i % 4, 1 + (i * 7) % 28),
                25 if i in (17, 60) else 1 + i % 3,
                None if i % 13 == 0 else (i % 4) * 10,
                spellings[i % 7],
                None if i % 9 == 0 else 1 + (i * 3) % 5,
                1 if (i * 7) % 5 < 2 else 0,
            )
        )
    for k, i in enumerate((3, 17, 26, 40, 77)):
        copy = list(orders[i])
        copy[0], copy[6] = f"O{120 + k}", copy[6].upper()
        orders.append(tuple(copy))
    return orders, products, customers


@pytest.fixture(scope="session")
def retail(spark):
    from decimal import Decimal

    orders, products, customers = retail_rows()
    products = [(a, b, c, Decimal(str(d))) for a, b, c, d in products]
    return Retail(
        spark.createDataFrame(orders, schemas.ORDERS).cache(),
        spark.createDataFrame(products, schemas.PRODUCTS).cache(),
        spark.createDataFrame(customers, schemas.CUSTOMERS).cache(),
    )


def as_dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
