"""Text to number, where anything unreadable becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlens.functions.labels import strip_whitespace

# The Java parser behind the cast also takes '12d' and '12f', which are not numbers here.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(text: Column, to: str = "double") -> Column:
    """Read ``text`` as a number; blanks and bad spellings become NULL.

    With an integer target a fraction is bad too: it would be lost silently.
    """
    value = strip_whitespace(text.cast("string"))
    number = F.when(value.rlike(NUMBER), value.try_cast("double"))
    if to == "double":
        return number
    whole = number.try_cast(to)
    return F.when(whole == number, whole)
