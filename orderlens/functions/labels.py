"""Labels: cleaning spellings, months, discount buckets and spend tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode text, as a set of
# characters to trim and as a pattern to split at.
WHITESPACE_CHARACTERS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
RARE_WHITESPACE = (
    r"[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WHITESPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# Names of the discount buckets and of the spend tiers.
DISCOUNT_BUCKETS = ("1. No discount (0%)", "2. Low (1-10%)", "3. Medium (11-20%)", "4. High (21-30%)")
SPEND_TIERS = ("Low value", "Mid value", "High value")


def strip_whitespace(text: Column) -> Column:
    """Remove white space of any kind at both ends.

    Spaces go by the fast SQL ``trim``; only texts that still start or end with a control
    character, or hold a character beyond ASCII, are compared with the whole set.
    """
    trimmed = F.trim(text)
    edge = (F.substring(trimmed, 1, 1) <= " ") | (F.substring(trimmed, -1, 1) <= " ")
    other = F.octet_length(trimmed) != F.char_length(trimmed)
    return F.when(edge | other, F.btrim(trimmed, F.lit(WHITESPACE_CHARACTERS))).otherwise(trimmed)


def clean_label(text: Column) -> Column:
    return F.upper(strip_whitespace(text))


def upper_trim(text: Column) -> Column:
    return F.upper(F.trim(text))


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def discount_bucket(discount_pct: Column, low: int = 10, medium: int = 20) -> Column:
    none, small, middle, high = DISCOUNT_BUCKETS
    return (
        F.when(F.coalesce(discount_pct, F.lit(0)) == 0, none)
        .when(discount_pct <= low, small)
        .when(discount_pct <= medium, middle)
        .otherwise(high)
    )


def spend_tier(spend: Column, edges: Sequence[float] = (1200, 2500)) -> Column:
    """Right-closed bins: a spend equal to an edge stays in the lower tier."""
    low, mid = edges
    return (
        F.when(spend <= -1, F.lit(None).cast("string"))
        .when(spend <= low, SPEND_TIERS[0])
        .when(spend <= mid, SPEND_TIERS[1])
        .when(spend > mid, SPEND_TIERS[2])
    )
