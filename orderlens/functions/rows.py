"""Turn an array of structs into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpack(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """One row per element, its fields as columns after the columns in ``keep``.

    The projection over the generator is deliberate: ``inline`` as the last step of a plan
    can be pruned to other columns than it should return when it reads nested fields.
    """
    return df.select(*keep, F.explode(array).alias("_row")).select(*keep, "_row.*")
