"""Numbers inside text: rendering, tokens and counting words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlens.functions.labels import RARE_WHITESPACE, WHITESPACE

# What counts as a date, a month and a number, in any script's digits.
DIGIT = r"\p{Nd}"
DATE = r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}"
MONTH = r"\p{Nd}{4}-\p{Nd}{2}"
NUMBER = r"\p{Nd}[\p{Nd},]*\.?\p{Nd}*"
SIGNED_NUMBER = r"(?:(?<![\p{L}\p{Nd}.,])-)?" + NUMBER


def number_tokens(text: Column, signed: bool = False) -> Column:
    """The distinct numbers of a text, without commas; dates and months do not count.

    Signs are ignored unless ``signed``, and a full stop right after a number belongs to
    its token, so ``175.`` and ``175`` are two tokens.
    """
    masked = F.regexp_replace(F.regexp_replace(text, DATE, " DATE "), MONTH, " MONTH ")
    found = F.regexp_extract_all(masked, F.lit(SIGNED_NUMBER if signed else NUMBER), F.lit(0))
    tokens = F.array_distinct(F.transform(found, lambda token: F.replace(token, F.lit(","), F.lit(""))))
    # Most texts hold no digit at all; one short search spares them the three passes.
    return F.when(text.rlike(DIGIT), tokens).otherwise(F.array().cast("array<string>"))


def plain_number(value: Column) -> Column:
    """The shortest decimal text of a double, never in scientific form: 2501.9, 175.0."""
    text = value.cast("double").cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.replace(F.substring_index(text, "E", 1), F.lit("-"), F.lit(""))
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    whole = F.substring_index(mantissa, ".", 1)
    rest = F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), whole, rest)
    filled = F.rpad(rest, F.greatest(exponent, F.length(rest)), "0")
    tail = F.substr(filled, exponent + 1)
    large = F.concat(sign, whole, F.substr(filled, F.lit(1), exponent), F.lit("."), F.when(tail == "", "0").otherwise(tail))
    expanded = F.when(exponent < 0, small).otherwise(large)
    return F.when(text.contains("E"), expanded).when(~text.isin("NaN", "Infinity", "-Infinity"), text)


def renderings(value: Column) -> Column:
    """The spellings that count as stating ``value``: two digits, no digits, plain."""
    return F.array_compact(
        F.array(
            F.replace(F.format_number(value, 2), F.lit(","), F.lit("")),
            F.replace(F.format_number(value, 0), F.lit(","), F.lit("")),
            plain_number(value),
        )
    )


def amount_text(value: Column) -> Column:
    return F.format_number(F.round(value, 2), 2)


def word_count(text: Column) -> Column:
    """Number of words between white space of any kind.

    Only texts with rare white space are split by the large character class.
    """

    def words(pattern: str) -> Column:
        return F.size(F.array_remove(F.split(text, f"{pattern}+"), "")).cast("long")

    return F.when(text.rlike(RARE_WHITESPACE), words(WHITESPACE)).otherwise(words(r"\s"))
