"""Pearson correlations of numeric columns, and verdicts on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.rows import unpack

MEASURES = ("quantity", "discount_pct", "rating", "returned", "order_value")


def correlation_matrix(df: DataFrame, columns: Sequence[str] = MEASURES, digits: int = 3) -> DataFrame:
    """All pairs as rows ``(var_x, var_y, r)``; rows with a NULL in a pair do not count for it.

    One aggregate over one scan computes every pair. A constant column has no correlation:
    its r is NULL (the built-in ``corr`` would raise an error instead).
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = df.agg(*[_pearson(columns[i], columns[j], digits).alias(f"r_{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(
            F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"r_{min(i, j)}_{max(i, j)}").alias("r")
        )
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return unpack(one, F.array(*cells))


def _pearson(a: str, b: str, digits: int) -> Column:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.round(F.try_divide(F.covar_pop(x, y), spread), digits)


def moments(columns: Sequence[str], pairs: Sequence[tuple[int, int]] | None = None) -> list[Column]:
    """Aggregates of cells from which the matrix can be merged: one struct for each pair of columns.

    For the rows without a NULL in the pair: their number, both means, both sums of squares and
    the sum of products about these means.
    """
    kept = []
    for i, j in pairs or pairs_of(len(columns)):
        x, y = F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        n = F.count(x)
        kept.append(
            F.struct(
                n.alias("n"),
                F.avg(x).alias("x"),
                F.avg(y).alias("y"),
                (F.var_pop(x) * n).alias("xx"),
                (F.var_pop(y) * n).alias("yy"),
                (F.covar_pop(x, y) * n).alias("xy"),
            ).alias(_pair(i, j))
        )
    return kept


def pairs_of(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def _pair(i: int, j: int) -> str:
    return f"moments_{i}_{j}"


def merged_r(i: int, j: int, digits: int = 3) -> Column:
    """Aggregate of cells: the correlation of columns ``i`` and ``j`` over all their rows.

    Sums within the cells plus sums between their means. A sum of squares no larger than
    the rounding of its parts is that of a constant, which has no correlation.
    """
    c = F.col(_pair(i, j))
    n = F.sum(c["n"])

    def about_mean(within: str, a: str, b: str) -> Column:
        between = F.sum(c["n"] * c[a] * c[b]) - F.sum(c["n"] * c[a]) * F.sum(c["n"] * c[b]) / n
        return F.sum(c[within]) + between

    def spread(within: str, a: str) -> Column:
        total = about_mean(within, a, a)
        return F.when(total > F.sum(c["n"] * c[a] * c[a]) * F.lit(1e-12), total)

    return F.round(F.try_divide(about_mean("xy", "x", "y"), F.sqrt(spread("xx", "x")) * F.sqrt(spread("yy", "y"))), digits)


def merged_matrix(cells: DataFrame, columns: Sequence[str] = MEASURES, digits: int = 3) -> DataFrame:
    """``correlation_matrix`` of all rows behind cells that hold ``moments(columns)``: no row is read again."""
    pairs = pairs_of(len(columns))
    one = cells.agg(*[merged_r(i, j, digits).alias(f"r_{i}_{j}") for i, j in pairs])
    cell = [
        F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"r_{min(i, j)}_{max(i, j)}").alias("r"))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return unpack(one, F.array(*cell))


def correlation_checks(matrix: DataFrame, target: str = "returned", weak: float = 0.15) -> DataFrame:
    """The correlation of each column with the target, and whether it is weak."""
    return (
        matrix.filter((F.col("var_y") == target) & (F.col("var_x") != target))
        .select(
            F.col("var_x").alias("variable"),
            "r",
            F.when(F.abs("r") < weak, "weak").when(F.col("r").isNotNull(), "notable").alias("verdict"),
        )
        .orderBy("variable")
    )
