"""Quality rules: text statistics and a decision list learned from labels, all in Spark functions.

Statistics are counts over the whole text. The list is grown by sequential covering: each rule
is a conjunction of thresholds on the statistics' ratios that gathers bad documents, grown
condition by condition for information gain on two thirds of the labelled documents, pruned
from its end on the others, and kept only if it is precise on them; what it covers is taken
out before the next. Labelled documents are folded into cells of binned ratios first, so each
step is one grouped sum, and the driver sees only sums for each statistic and bin. The list
becomes one ordered conditional expression.

Defined cases: a null or empty text has no words, all counts 0, and fails the base; repeated
rows are judged each; null labels don't count, and a document labelled several times is bad if
any label says so; without labels, or without bad ones, the list is empty and keeps all that
passes the base; an empty table gives no rows. A window of words is compared by a 64-bit hash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.session import stage

SPAN = 8
#: Thresholds for each ratio and class of label; conditions in a rule; rules in the list.
QUANTILES, CONDITIONS, MOST_RULES = 15, 4, 12
#: A rule must be that precise on the pruning third, and cover that many documents there.
PRECISION, COVERAGE = 0.9, 5
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS, MARKS = "#*$%&|<>", "!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_marks", "n_lines")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, the counts of ``COUNTS`` and ``EXTRA`` for every row."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col(column), F.lit("")).alias("text"))
    worded = lambda line: F.length(F.translate(line, WHITE, "")) > 0
    rows = rows.select(
        "doc_id",
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "").alias("words"),
        F.filter(F.split(text, "\n", -1), worded).alias("lines"),
        _without(text, WHITE).cast("long").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - _without(text, MARKS)).cast("long").alias("n_marks"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "n_marks", "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    last = F.col("n_words").cast("int") - (SPAN - 1)
    windows = F.transform(F.sequence(F.lit(1), last), lambda k: F.xxhash64(F.slice("hashes", k, SPAN)))
    rows = rows.withColumn("windows", F.when(last > 0, windows).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    # windows in order of hash, so that equal ones are neighbours; only where some are equal
    ordered = F.array_sort(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    none = F.array().cast("array<struct<h:bigint,k:int>>")
    rows = rows.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered).otherwise(none)).drop("windows")
    twice = lambda x, i: (F.get("ordered", i - 1)["h"] == x["h"]) | (F.get("ordered", i + 1)["h"] == x["h"])
    rows = rows.withColumn("starts", F.array_sort(F.transform(F.filter("ordered", lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["k"]))).drop("ordered")
    step = lambda seen, k: F.struct((seen["n"] + F.least(F.lit(SPAN), k + SPAN - seen["end"])).alias("n"), (k + SPAN).alias("end"))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"].cast("long")
    return rows.select("doc_id", *(covered.alias(c) if c == "n_repeat_words" else c for c in (*COUNTS, *EXTRA)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """What thresholds are put on; 0 where there is nothing to divide by."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "marks_per_word": per("n_marks", "n_words"),
        "upper_per_char": per("n_upper", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """``ratio >= threshold`` if ``above``, else ``ratio < threshold``; ``bin`` is the threshold's number."""

    ratio: str
    above: bool
    threshold: float
    bin: int

    def on_values(self) -> Column:
        value = ratios()[self.ratio]
        return value >= self.threshold if self.above else value < self.threshold

    def on_bins(self) -> Column:
        return F.col(self.ratio) >= self.bin if self.above else F.col(self.ratio) < self.bin


Rule = tuple[Condition, ...]


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each ratio among the bad and among the good documents: a bounded list for each."""
    share = [k / (QUANTILES + 1) for k in range(1, QUANTILES + 1)]
    names = list(ratios())
    found = rows.groupBy("bad").agg(*(F.percentile_approx(r, share, 1000).alias(r) for r in names)).collect()
    return {r: sorted({x for row in found for x in row[r] or []}) for r in names}


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gain of a refinement, times the bad documents that stay."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _grow(cells: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        names = list(cuts)
        each = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(r).alias("bin")) for r in names))).alias("at")
        part = cells.where(_all(c.on_bins() for c in rule)).select("bad", "good", each)
        sums = {(r.ratio, r.bin): (r.bad, r.good) for r in part.groupBy("at.ratio", "at.bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}
        first = names[0]
        bad, good = (sum(v[k] for (r, _), v in sums.items() if r == first) for k in (0, 1))
        if not bad or not good:
            break
        best, gain = None, 1e-9
        for ratio in names:
            b = g = 0
            for number, cut in enumerate(cuts[ratio], 1):
                x, y = sums.get((ratio, number - 1), (0, 0))
                b, g = b + x, g + y
                for above, p, n in ((False, b, g), (True, bad - b, good - g)):
                    if (now := _gain(p, n, bad, good)) > gain:
                        best, gain = Condition(ratio, above, cut, number), now
        if best is None:
            break
        rule += (best,)
    return rule


def _prune(cells: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of ``rule`` that is worth most on other documents, with the bad and good ones it covers there."""
    sums = []
    for k in range(1, len(rule) + 1):
        met = _all(c.on_bins() for c in rule[:k])
        sums += [F.coalesce(F.sum(F.when(met, F.col(c))), F.lit(0)) for c in ("bad", "good")]
    found = cells.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first()
    return max(((rule[: k + 1], found[2 * k], found[2 * k + 1]) for k in range(len(rule))), key=lambda x: ((x[1] - x[2]) / max(x[1] + x[2], 1), x[1]))


def learn(rows: DataFrame) -> list[Rule]:
    """The decision list from labelled rows: doc_id, counts, bad."""
    rows = rows.select("doc_id", "bad", *(e.alias(r) for r, e in ratios().items()))
    cuts = thresholds(rows)
    if not any(cuts.values()):
        return []
    binned = [reduce(lambda a, b: a + b, ((F.col(r) >= t).cast("int") for t in own), F.lit(0)).alias(r) for r, own in cuts.items()]
    folded = rows.select((F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grows"), F.col("bad").cast("long").alias("b"), *binned)
    cells = stage(folded.groupBy("grows", *cuts).agg(F.sum("b").alias("bad"), F.sum(1 - F.col("b")).alias("good")), "cells")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        grown = _grow(cells.where("grows"), cuts)
        if not grown:
            break
        rule, bad, good = _prune(cells.where("not grows"), grown)
        if bad + good < COVERAGE or bad < PRECISION * (bad + good):
            break
        rules.append(rule)
        cells = cells.where(~_all(c.on_bins() for c in rule))
    return rules


def kept_by(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the first rule that fits rejects."""
    out = F
    for rule in rules:
        out = out.when(_all(c.on_values() for c in rule), False)
    return out.otherwise(True) if rules else F.lit(True)


def judge(docs: DataFrame, labels: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, the five counts, base_failed, kept of every document."""
    rows = stage(statistics(docs, column), "statistics")
    said = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    rules = learn(rows.where(~base_failed()).join(said, "doc_id"))
    return rows.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & kept_by(rules)).alias("kept"))
