"""Check the numbers inside texts against computed figures, in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.rows import unpack
from orderlens.functions.text import number_tokens, renderings
from orderlens.operators.skew import NO_HOT_KEYS, HotKeys, spread_join

# Years need no support, nor do numbers of one or two characters.
FIRST_YEAR, LAST_YEAR = 2000, 2099


def _expected(headline: DataFrame) -> Column:
    """The headline figures as one array; a headline is a short fixed list of labels."""
    figure = F.struct("label", renderings(F.col("value")).alias("forms"))
    return headline.agg(F.array_sort(F.collect_list(figure)).alias("figures")).scalar()


def _tokens(texts: DataFrame, signed: bool) -> DataFrame:
    return texts.select("text_id", number_tokens(F.col("text"), signed).alias("tokens"))


def headline_check(texts: DataFrame, headline: DataFrame, signed: bool = False) -> DataFrame:
    """``(text_id, label, ok)``: does the text state the figure in one of its renderings?

    The figures travel as one value, so no text is shuffled or joined.
    """
    checks = F.transform(
        "figures",
        lambda f: F.struct(f["label"].alias("label"), F.arrays_overlap("tokens", f["forms"]).alias("ok")),
    )
    return unpack(_tokens(texts, signed).withColumn("figures", _expected(headline)), checks, "text_id")


def headline_score(texts: DataFrame, headline: DataFrame, signed: bool = False) -> DataFrame:
    """Matched and expected figures of each text, and how many numbers it holds."""
    checked = _tokens(texts, signed).withColumn("figures", _expected(headline))
    hits = F.filter("figures", lambda f: F.arrays_overlap("tokens", f["forms"]))
    return checked.select(
        "text_id",
        F.size(hits).cast("long").alias("matched"),
        F.size("figures").cast("long").alias("total"),
        F.size("tokens").cast("long").alias("numbers"),
    )


def own_figures_check(texts: DataFrame, figures: DataFrame, signed: bool = False) -> DataFrame:
    """``headline_check`` where each text has figures of its own, ``(text_id, label, value)``."""
    return (
        _tokens(texts, signed)
        .join(figures, "text_id")
        .select("text_id", "label", F.arrays_overlap("tokens", renderings(F.col("value"))).alias("ok"))
    )


def own_figures_score(checked: DataFrame) -> DataFrame:
    """Matched and expected figures per text of ``own_figures_check``."""
    return checked.groupBy("text_id").agg(
        F.count_if("ok").alias("matched"), F.count(F.lit(1)).alias("total")
    )


def needs_support(token: Column) -> Column:
    year = token.rlike(r"^[0-9]{4}$") & token.try_cast("int").between(FIRST_YEAR, LAST_YEAR)
    return (F.length(token) > 2) & ~F.coalesce(year, F.lit(False))


def unsupported_numbers(
    texts: DataFrame, figures: DataFrame, signed: bool = False, hot: HotKeys = NO_HOT_KEYS
) -> DataFrame:
    """``(text_id, token)``: numbers of a text that no figure in ``figures.value`` explains.

    Numbers that need no support are dropped inside the row, before the anti join. How the
    allowed spellings are joined is left to their measured size; ``hot`` names tokens to
    spread if there are too many spellings to broadcast.
    """
    tokens = _tokens(texts, signed).select(
        "text_id", F.explode(F.filter("tokens", needs_support)).alias("token")
    )
    allowed = figures.select(F.explode(renderings(F.col("value"))).alias("token")).distinct()
    return spread_join(tokens, allowed, "token", "left_anti", hot).select("text_id", "token")
