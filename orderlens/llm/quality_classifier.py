"""Quality classifier: a document's own evidence, combined with what is known of its site.

Evidence is a logistic regression over hashed words and stepped style figures, one for low
quality and one for toxicity, fitted on all labelled documents. Sites form
a hierarchy: all documents, a host, a path of the host. By empirical Bayes the share of bad
labels of a host shrinks towards the overall share, and that of a path towards its host's, by
strengths estimated from the spread between hosts and between paths (method of moments, from
grouped sums). A document's odds are those of its evidence times the odds of its path over the
overall odds; it is rejected if low quality or toxicity is more likely than not.

Defined cases: a null text is empty; null hosts and paths are sites of their own; unlabelled
sites take their parent's share; documents labelled several times count as bad if any label
says so, null labels not at all; with no labels, or of one kind only, evidence is the smoothed
share itself; even odds (a tie) reject nothing; repeated rows are judged each; very long texts
count whole; other columns may have any name; an empty table gives no rows.

The sites are a table written to the shared folder, so that its true size decides whether it is
broadcast; where it is too large, rows of hot hosts and paths are spread over salts. The
classifier's rows leave their texts behind before they meet the sites.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import apart
from orderlens.operators.skew import hot_keys, spread_join
from orderlens.session import stage

FEATURES = 1 << 17
ITERATIONS, PENALTY = 30, 3e-4
#: Style figures count in whole numbers up to this one.
STEPS = 20
#: Evidence and shares stay this far from certainty.
LARGEST_LOGIT, SMOOTHING = 12.0, 1.0
#: Strengths of a prior (in labels) when sites differ as much as can be, and not at all.
WEAKEST, STRONGEST = 1.0, 1e6
TARGETS = ("quality", "toxic")


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def features(text: Column) -> Column:
    """Distinct words, and steps of style figures."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")
    raw = F.array_remove(F.split(text, r"\s+", -1), "")
    distinct = F.array_distinct(words)
    size = F.greatest(F.length(text), F.lit(1))
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>!?_=~^", ""))
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    style = {
        "marks": 10 * share(marks, F.size(raw)),
        "upper": 20 * share(upper, size),
        "repeated": 20 - 20 * share(F.size(distinct), F.size(words)),
        "short": 12 - F.log2(F.size(raw) + 1),
    }
    return F.concat(distinct, *(_steps(name, value) for name, value in style.items()))


def _steps(name: str, value: Column) -> Column:
    """A feature for each whole number up to ``value``, so that a high figure has many votes."""
    last = F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(STEPS)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.concat(F.lit(f" {name}>="), k.cast("string")))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with a label and whether each target is bad (null if not said)."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("quality"), (F.max("toxic") == 1).alias("toxic"))
    return rows.join(said, "doc_id")


@dataclass(frozen=True)
class Site:
    """Shares of bad documents: overall, and the strengths of the priors of hosts and paths."""

    share: float
    host_strength: float
    path_strength: float


def _strength(share: float, spread: float, groups: int, total: float, squares: float) -> float:
    """Prior strength by the method of moments from sum n (p - mean)**2 over the groups."""
    within = share * (1 - share)
    room = total - squares / total if total else 0.0
    between = (spread - (groups - 1) * within) / room if room > 0 else 0.0
    return min(max(within / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST


def sites(known: DataFrame, *targets: str) -> tuple[DataFrame, dict[str, Site]]:
    """host, path and, for every target, its shares at the host and at the path (``<target>_at_host``,
    ``<target>_at_path``) of the labelled sites, by grouped sums of all targets at once; and the priors.

    A site without a label of a target has its parent's share."""
    counts = [c for t in targets for c in (F.count(t).alias(f"{t}_n"), F.coalesce(F.sum(F.col(t).cast("long")), F.lit(0)).alias(f"{t}_bad"))]
    paths = stage(known.groupBy("host", "path").agg(*counts), "paths")
    summed = [f"{t}_{x}" for t in targets for x in ("n", "bad")]
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(f"host_{c}") for c in summed))
    all_ = paths.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed)).first()
    share = {t: (all_[f"{t}_bad"] + SMOOTHING) / (all_[f"{t}_n"] + 2 * SMOOTHING) for t in targets}

    def strengths(groups: DataFrame, prefix: str, mean: dict[str, Column]) -> dict[str, float]:
        sums = []
        for t in targets:
            n, p = F.col(f"{prefix}{t}_n"), F.col(f"{prefix}{t}_bad") / F.greatest(F.col(f"{prefix}{t}_n"), F.lit(1))
            sums += [(F.sum(n * (p - mean[t]) ** 2), f"{t}_spread"), (F.sum(n.cast("double") ** 2), f"{t}_squares"), (F.sum((n > 0).cast("long")), f"{t}_groups")]
        got = groups.agg(*(F.coalesce(x, F.lit(0)).alias(name) for x, name in sums)).first()
        return {t: _strength(share[t], float(got[f"{t}_spread"]), got[f"{t}_groups"], all_[f"{t}_n"], float(got[f"{t}_squares"])) for t in targets}

    at_host = strengths(hosts, "host_", {t: F.lit(share[t]) for t in targets})
    shrunk = [((F.col(f"host_{t}_bad") + at_host[t] * share[t]) / (F.col(f"host_{t}_n") + at_host[t])).alias(f"{t}_at_host") for t in targets]
    hosts = hosts.select(F.col("host").alias("_host"), *shrunk)
    both = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    at_path = strengths(both, "", {t: F.col(f"{t}_at_host") for t in targets})
    shares = [c for t in targets for c in (F.col(f"{t}_at_host"), ((F.col(f"{t}_bad") + at_path[t] * F.col(f"{t}_at_host")) / (F.col(f"{t}_n") + at_path[t])).alias(f"{t}_at_path"))]
    return both.select("host", "path", *shares), {t: Site(share[t], at_host[t], at_path[t]) for t in targets}


def evidence(rows: DataFrame, target: str) -> Callable[[DataFrame], DataFrame]:
    """From rows (vector, target): a function that adds ``target``'s log odds to rows with ``vector``."""
    rows = rows.where(F.col(target).isNotNull()).select("vector", F.col(target).cast("double").alias("label"))
    kinds = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = kinds.get(0.0, 0), kinds.get(1.0, 0)
    if not good or not bad:
        share = (bad + SMOOTHING) / (good + bad + 2 * SMOOTHING)
        return lambda df: df.withColumn(f"{target}_odds", logit(F.lit(share)))
    model = LogisticRegression(featuresCol="vector", maxIter=ITERATIONS, regParam=PENALTY, standardization=False).fit(rows)
    model.setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
    odds = F.greatest(F.least(vector_to_array("_raw")[1], F.lit(LARGEST_LOGIT)), F.lit(-LARGEST_LOGIT))
    return lambda df: model.transform(df).withColumn(f"{target}_odds", odds).drop("_raw")


def site_key(*names: str) -> Column:
    """Text of a host, or a host and path, that tells nulls from empty names and is never null."""
    return F.to_json(F.struct(*(F.col(n).alias(f"k{i}") for i, n in enumerate(names))))


def shrunk_sites(known: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, Site]]:
    """Shares of all targets by ``_site`` and by ``_host``, written tables, and the priors."""
    shares, priors = sites(known, *TARGETS)
    at_site = stage(shares.select(site_key("host", "path").alias("_site"), site_key("host").alias("_host"), *shares.columns[2:]), "sites")
    at_host = stage(at_site.groupBy("_host").agg(*(F.max(f"{t}_at_host").alias(f"{t}_at_host") for t in TARGETS)), "hosts")
    return at_site.select("_site", *(f"{t}_at_path" for t in TARGETS)), at_host, priors


def judged(docs: DataFrame, labels: DataFrame, column: str = "text", host: str = "source", path: str = "lang", carried: list[str] | None = None) -> DataFrame:
    """The columns ``carried`` (all) of ``docs`` and, as one struct ``_verdict``, quality, toxic (probabilities
    of good quality and of toxicity), host_share, path_share (of low quality) and kept."""
    hashing = HashingTF(inputCol="_features", outputCol="vector", numFeatures=FEATURES, binary=True)
    vectors = lambda df: hashing.transform(df.withColumn("_features", features(F.coalesce(F.col(column), F.lit(""))))).drop("_features")
    keys = {"_site": site_key(host, path), "_host": site_key(host)}
    # made once: the labelled ones train, all are judged
    work = docs.select("doc_id", F.struct(*(carried or docs.columns)).alias("_row"), column, *(key.alias(k) for k, key in keys.items()))
    work = stage(vectors(work).drop(column), "vectors")
    known = labelled(docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path")), labels)
    sample = stage(labelled(work.select("doc_id", "vector"), labels).select("vector", *TARGETS), "sample")
    at_site, at_host, priors = shrunk_sites(known)
    work = work.drop("doc_id")
    for target in TARGETS:
        work = evidence(sample, target)(work)
    work = work.drop("vector")
    for (k, key), shares in zip(keys.items(), (at_site, at_host), strict=True):
        work = spread_join(work, shares, k, "left", hot_keys(docs.select(key.alias(k)), k), ["quality_odds", "toxic_odds"]).drop(k)
    for target in TARGETS:
        prior = priors[target]
        host_share = F.coalesce(f"{target}_at_host", F.lit(prior.share))
        path_share = F.coalesce(f"{target}_at_path", host_share)
        odds = F.col(f"{target}_odds") + logit(path_share) - logit(F.lit(prior.share))
        work = work.withColumn(f"{target}_bad", 1 / (1 + F.exp(-odds)))
        if target == "quality":
            work = work.withColumn("host_share", host_share).withColumn("path_share", path_share)
    kept = (F.col("quality_bad") <= 0.5) & (F.col("toxic_bad") <= 0.5)
    verdict = F.struct((1 - F.col("quality_bad")).alias("quality"), F.col("toxic_bad").alias("toxic"), "host_share", "path_share", kept.alias("kept"))
    return work.select("_row.*", verdict.alias("_verdict"))


def classify(docs: DataFrame, labels: DataFrame, column: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, host, path, quality, toxic, host_share, path_share, kept of every document."""
    rows = judged(docs.select("doc_id", column, host, path), labels, column, host, path, ["doc_id", host, path])
    return rows.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "_verdict.*")


def drop_rejected(docs: DataFrame, labels: DataFrame, column: str = "text", host: str = "source", path: str = "lang") -> DataFrame:
    given = apart(docs, "doc_id", column, host, path)
    return judged(given, labels, column, host, path).where("_verdict.kept").select(*given.columns).toDF(*docs.columns)
