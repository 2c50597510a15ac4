"""Exact quantiles of a column of any size, without gathering its values in one task.

A sketch brackets each wanted rank, then histogram passes narrow the bracket until one
value is left. A pass shuffles at most a few thousand counters, whatever the size of the
table, and brings two rows per quantile to the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import stage

CELLS = 4096
SKETCH_ACCURACY = 10_000
#: Cells beside the CELLS inside a bracket: below it, minus infinity, infinity, above it.
BELOW, LOWEST, HIGHEST, ABOVE = -2, -1, CELLS, CELLS + 1


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Quantiles with linear interpolation; NULL and NaN are left out."""
    return quantiles_of(df, {column: probabilities})[column]


def quantiles_of(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """``exact_quantiles`` for several columns, which share the first pass."""
    values = df.select(
        *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in wanted]
    )
    slack = 2 / SKETCH_ACCURACY
    sketches = []
    for c, probabilities in wanted.items():
        edges = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-slack, slack)]
        sketches.append(
            F.struct(F.count(c).alias("n"), F.percentile_approx(c, edges, SKETCH_ACCURACY).alias("edges")).alias(c)
        )
    seen = values.agg(*sketches).first()
    result: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in wanted}
    for c in wanted:
        if seen[c]["n"] and wanted[c]:
            one = values.select(F.col(c).alias("v")).filter("v IS NOT NULL")
            result[c] = _by_histograms(one, wanted[c], seen[c]["n"], seen[c]["edges"])
    return result


def _by_histograms(
    values: DataFrame, probabilities: Sequence[float], n: int, edges: Sequence[float]
) -> list[float | None]:
    positions = [p * (n - 1) for p in probabilities]
    brackets: dict[int, tuple[float, float]] = {}
    for i, position in enumerate(positions):
        for rank in (math.floor(position), math.ceil(position)):
            brackets[rank] = (edges[2 * i], edges[2 * i + 1])
    found: dict[int, float] = {}
    started: set[int] = set()
    while brackets:
        for rank, (low, high) in _narrow(values, brackets).items():
            if low == high:
                found[rank] = low
                del brackets[rank]
            elif rank in started and (low, high) == brackets[rank]:
                raise RuntimeError(f"rank {rank} stays between {low} and {high}")
            else:
                started.add(rank)
                brackets[rank] = (low, high)
    return [_between(found[math.floor(at)], found[math.ceil(at)], at) for at in positions]


def _between(low: float, high: float, at: float) -> float:
    """The interpolation of the built-in percentile, step by step."""
    if low == high:
        return low
    return (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def _cell(v: Column, low: float, high: float) -> Column:
    """The number of the cell of ``v``: equal parts of the bracket's finite span, infinities apart."""
    first, last = max(low, -sys.float_info.max), min(high, sys.float_info.max)
    if not first < last:
        inside = F.lit(0)
    elif math.isfinite(last - first):
        inside = F.floor((v - first) / (last - first) * CELLS)
    else:
        inside = F.floor((v / 2 - first / 2) / (last / 2 - first / 2) * CELLS)
    return (
        F.when(v < low, BELOW)
        .when(v == -math.inf, LOWEST)
        .when(v > high, ABOVE)
        .when(v == math.inf, HIGHEST)
        .otherwise(F.least(inside, F.lit(CELLS - 1)))
    )


def _narrow(values: DataFrame, brackets: dict[int, tuple[float, float]]) -> dict[int, tuple[float, float]]:
    """One histogram pass: the smallest and largest value of the cell holding each rank.

    After the first pass both ends of a bracket are values that occur and lie in different
    cells, so every further pass narrows it.
    """
    spans = sorted(set(brackets.values()))
    v = F.col("v")
    cells = [
        F.struct(F.lit(i).alias("span"), _cell(v, low, high).cast("int").alias("cell"))
        for i, (low, high) in enumerate(spans)
    ]
    histogram = (
        values.select("v", F.explode(F.array(*cells)).alias("at"))
        .groupBy("at.span", "at.cell")
        .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    # At most (CELLS + 4) rows per span enter the window.
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("cell"))
    ranked = histogram.select("span", "low", "high", "n", upto.alias("upto"))
    wanted = F.lit(False)
    for rank, span in brackets.items():
        hit = (F.col("span") == spans.index(span)) & (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank)
        wanted = wanted | hit
    rows = ranked.filter(wanted).collect()
    return {
        rank: (row["low"], row["high"])
        for rank, span in brackets.items()
        for row in rows
        if row["span"] == spans.index(span) and row["upto"] - row["n"] <= rank < row["upto"]
    }


def grouped_quantiles(df: DataFrame, keys: Sequence[str], column: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles of each group: ``keys``, ``n_values`` and the array ``quantiles``.

    Same results as ``exact_quantiles`` for each group, for any number of groups: the brackets are
    rows (group, rank, low, high), and one pass narrows those of all groups. A pass joins the
    values of the open groups to their brackets (a few rows for each group, broadcast where Spark
    finds them small) and shuffles counters of cells; a group of any size leaves at most
    CELLS + 4 of them for each bracket. Groups without values have NULL quantiles; NULL keys
    are a group.
    """
    group = [f"_g{i}" for i in range(len(keys))]
    values = df.select(
        *[F.col(k).alias(g) for k, g in zip(keys, group, strict=True)],
        F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("v"),
    )
    slack = 2 / SKETCH_ACCURACY
    edges = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-slack, slack)]
    seen = values.groupBy(*group).agg(F.count("v").alias("n"), F.percentile_approx("v", edges, SKETCH_ACCURACY).alias("edges"))
    seen = stage(seen, "group-sizes")
    wanted = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("n") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            wanted.append(F.struct(rank.cast("long").alias("rank"), F.col("edges")[2 * i].alias("low"), F.col("edges")[2 * i + 1].alias("high")))
    brackets = seen.where("n > 0").select(*group, F.explode(F.array(*wanted)).alias("b")).select(*group, "b.*")
    # a rank asked for twice, by two probabilities, needs only one bracket
    brackets = brackets.groupBy(*group, "rank").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = []
    brackets = stage(brackets, "brackets")
    while True:
        brackets = stage(_narrow_groups(values, brackets, group), "brackets")
        found.append(brackets.where("low = high"))
        brackets = brackets.where("low < high")
        if brackets.isEmpty():
            break
    ranks = reduce(DataFrame.unionByName, found).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("at"))
    joined = seen.join(_renamed(ranks, group), _same(group), "left")
    results = []
    for p in probabilities:
        at = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.try_element_at("at", low.cast("long")), F.try_element_at("at", high.cast("long"))
        results.append(F.when(a == b, a).otherwise((high - at) * a + (at - low) * b))
    return joined.select(
        *[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col("n").alias("n_values"), F.array(*results).alias("quantiles")
    )


def _narrow_groups(values: DataFrame, brackets: DataFrame, group: Sequence[str]) -> DataFrame:
    """One histogram pass for all groups: each bracket becomes the ends of the cell that holds its rank."""
    spans = _renamed(brackets.select(*group, "low", "high").distinct(), group)
    met = values.where("v IS NOT NULL").join(spans, _same(group)).select(*group, "low", "high", "v")
    first = F.greatest("low", F.lit(-sys.float_info.max))
    last = F.least("high", F.lit(sys.float_info.max))
    v = F.col("v")
    wide = last / 2 - first / 2 >= sys.float_info.max / 2  # the whole difference would overflow
    inside = F.when(first >= last, 0).when(wide, (v / 2 - first / 2) / (last / 2 - first / 2) * CELLS).otherwise((v - first) / (last - first) * CELLS)
    cell = (
        F.when(v < F.col("low"), BELOW)
        .when(v == -math.inf, LOWEST)
        .when(v > F.col("high"), ABOVE)
        .when(v == math.inf, HIGHEST)
        .otherwise(F.least(F.floor(inside), F.lit(CELLS - 1)))
    )
    histogram = met.groupBy(*group, "low", "high", cell.cast("int").alias("cell")).agg(
        F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    upto = F.sum("n").over(Window.partitionBy(*group, "low", "high").orderBy("cell"))
    ranked = histogram.withColumn("upto", upto)
    ranked = _renamed(ranked, [*group, "low", "high"]).withColumnRenamed("n", "here")
    hit = _same([*group, "low", "high"]) & (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("here") <= F.col("rank"))
    return brackets.join(ranked, hit).select(*group, "rank", F.col("least").alias("low"), F.col("most").alias("high"))


def _renamed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_of{c}" for c in columns})


def _same(columns: Sequence[str]) -> Column:
    """Equality of these columns with those of a ``_renamed`` frame; NULLs are equal."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in columns])
