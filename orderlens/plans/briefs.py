"""Business briefs: one text per subject, written from that subject's own figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.money import rate_pct
from orderlens.functions.rows import unpack
from orderlens.functions.text import amount_text

# Labels of the figures that every brief has to state.
HEADLINE = {
    "Total revenue (clean)": "revenue",
    "Average order value": "avg_order_value",
    "Overall return rate %": "return_rate_pct",
    "Worst payment rate %": "worst_rate_pct",
    "Highest-risk segment %": "risk_rate_pct",
    "Duplicate delta": "duplicate_delta",
    "Peak month revenue": "peak_revenue",
}


def _best(order: Column, *columns: str) -> Column:
    """The columns of the row with the largest ``order``; the smaller column values win ties."""
    return F.min(F.struct((-order).alias("_order"), *columns))


def _rated(cells: DataFrame, subject: str, *keys: str) -> DataFrame:
    return (
        cells.filter(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)) == F.lit(False))
        .groupBy(subject, *keys)
        .agg(F.sum("n").alias("orders"), rate_pct(F.sum("n_returned"), F.sum("n")).alias("rate"))
    )


def brief_figures(cells: DataFrame, orders: DataFrame, subject: str) -> DataFrame:
    """The figures of each subject, from what ``analyse`` has cleaned, flagged and folded.

    All but the lost product come from the cells. Each part aggregates to one row per
    subject; the parts are stacked and folded into one row.
    """
    n = F.sum("n")
    value = F.col("order_value")
    totals = cells.groupBy(subject).agg(
        n.alias("orders"),
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("last_day"),
        F.round(F.sum("amount"), 2).alias("revenue"),
        F.round(F.try_divide(F.sum("amount").cast("double"), n), 2).alias("avg_order_value"),
        rate_pct(F.sum("n_returned"), n).alias("return_rate_pct"),
        F.round(F.sum("amount") + F.sum("surplus"), 2).alias("raw_revenue"),
        F.round(F.sum("surplus"), 2).alias("duplicate_delta"),
    )
    payments = (
        _rated(cells, subject, "payment_method")
        .groupBy(subject)
        .agg(
            _best(F.col("rate"), "payment_method", "rate").alias("worst"),
            _best(-F.col("rate"), "payment_method", "rate").alias("best"),
        )
        .select(
            subject,
            F.col("worst.payment_method").alias("worst_payment"),
            F.col("worst.rate").alias("worst_rate_pct"),
            F.col("best.payment_method").alias("best_payment"),
            F.col("best.rate").alias("best_rate_pct"),
        )
    )
    risk = (
        _rated(cells, subject, "payment_method", "city_tier")
        .groupBy(subject)
        .agg(_best(F.col("rate"), "payment_method", "city_tier", "rate").alias("top"))
        .select(
            subject,
            F.col("top.payment_method").alias("risk_payment"),
            F.col("top.city_tier").alias("risk_tier"),
            F.col("top.rate").alias("risk_rate_pct"),
        )
    )
    peaks = (
        cells.filter(~F.col("is_outlier"))
        .groupBy(subject, "month")
        .agg(F.round(F.sum("amount"), 2).alias("amount"))
        .groupBy(subject)
        .agg(_best(F.col("amount"), "month", "amount").alias("top"))
        .select(subject, F.col("top.month").alias("peak_month"), F.col("top.amount").alias("peak_revenue"))
    )
    losses = (
        orders.filter((F.col("returned") == 1) & F.col("product_name").isNotNull())
        .groupBy(subject, "product_id", "product_name")
        .agg(F.round(F.sum(value), 2).alias("amount"))
        .groupBy(subject)
        .agg(_best(F.col("amount"), "product_id", "product_name", "amount").alias("top"))
        .select(
            subject,
            F.col("top.product_id").cast("string").alias("lost_product_id"),
            F.col("top.product_name").alias("lost_product"),
            F.col("top.amount").alias("lost_revenue"),
        )
    )
    stacked = totals
    for part in (payments, risk, peaks, losses):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    # Each column is filled by one part, once per subject.
    columns = [c for c in stacked.columns if c != subject]
    return (
        stacked.filter(F.col(subject).isNotNull())
        .groupBy(subject)
        .agg(*[F.max(c).alias(c) for c in columns])
    )


def _percent(column: str) -> Column:
    return F.concat(F.col(column).cast("string"), F.lit("%"))


def _amount(column: str) -> Column:
    return F.concat(F.lit("INR "), amount_text(F.col(column)))


def render_briefs(figures: DataFrame, subject: str) -> DataFrame:
    """``(text_id, text)`` in three sections; a figure that is missing reads ``n/a``."""

    def say(template: str, *parts: Column) -> Column:
        return F.format_string(template, *[F.coalesce(p.cast("string"), F.lit("n/a")) for p in parts])

    situation = say(
        "%s: %s clean orders from %s to %s brought in %s, on average %s per order. %s of them were returned.",
        F.col(subject),
        F.col("orders"),
        F.col("first_day"),
        F.col("last_day"),
        _amount("revenue"),
        _amount("avg_order_value"),
        _percent("return_rate_pct"),
    )
    complication = say(
        "Returns differ by payment method: %s stands at %s and %s at %s. The riskiest combination is %s in "
        "tier %s cities with %s. Copies had raised raw revenue to %s, which is %s too much. Without outliers "
        "the best month was %s with %s.",
        F.col("worst_payment"),
        _percent("worst_rate_pct"),
        F.col("best_payment"),
        _percent("best_rate_pct"),
        F.col("risk_payment"),
        F.col("risk_tier"),
        _percent("risk_rate_pct"),
        _amount("raw_revenue"),
        _amount("duplicate_delta"),
        F.col("peak_month"),
        _amount("peak_revenue"),
    )
    resolution = say(
        "1. Confirm %s orders before they ship, first in tier %s cities.\n"
        "2. Reward customers who pay by %s.\n"
        "3. Review %s (%s), whose returned orders were worth %s.\n"
        "4. Plan with figures that are free of copies and flagged for outliers.",
        F.col("worst_payment"),
        F.col("risk_tier"),
        F.col("best_payment"),
        F.col("lost_product"),
        F.col("lost_product_id"),
        _amount("lost_revenue"),
    )
    text = F.concat(
        F.lit("SITUATION\n"), situation, F.lit("\n\nCOMPLICATION\n"), complication, F.lit("\n\nRESOLUTION\n"), resolution
    )
    return figures.select(F.col(subject).cast("string").alias("text_id"), text.alias("text"))


def stated_figures(figures: DataFrame, subject: str) -> DataFrame:
    """The headline figures as rows ``(text_id, label, value)``."""
    cells = [F.struct(F.lit(label).alias("label"), F.col(c).cast("double").alias("value")) for label, c in HEADLINE.items()]
    return unpack(figures.withColumn("text_id", F.col(subject).cast("string")), F.array(*cells), "text_id")
