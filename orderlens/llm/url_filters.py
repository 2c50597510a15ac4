"""URL filters: fixed host and path rules, then association rules mined from labelled URLs.

A URL's tokens are its scheme, its host and that host's parents (not the last label), its path
segments (digits as ``#``, mere numbers left out), its query keys. Spark's FP-growth finds the token combinations that are frequent among
labelled URLs; combinations that occur with the bad label often enough (``MIN_SUPPORT``,
``MIN_CONFIDENCE``, above the overall share) are block rules, without those that a rule with
one token less already covers. Rules are looked up by an inverted index: each is listed under
its rarest token, found by the tokens of each distinct token set, and verified in full.

All of it is DataFrame functions. Defined cases: a null URL or one without ``://`` has empty
host and path, no tokens, and is allowed unless a fixed rule fits; repeated pages are judged
each; labels that are null don't count, and a URL labelled several times is bad if any label
says so; without labelled URLs no rule is learned and all else is allowed; rule ties (equal
length) go to the first in the list.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.session import stage

#: (verdict, host, path): fixed values of the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Share (and number) of the labelled URLs that hold a combination with the bad label; share of bad ones among all that hold it.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.002, 10, 0.8
#: No combination has more tokens; keeps the number of itemsets polynomial in that of frequent tokens.
LONGEST = 4
BAD = "label=bad"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens, sorted; an empty array for what is no URL."""
    labels = F.split(host, r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(path, "/", -1), lambda s: s != ""), lambda s: F.concat(F.lit("path="), F.regexp_replace(s, "[0-9]+", "#")))
    segments = F.array_remove(segments, "path=#")
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&", -1), lambda s: s != ""), lambda s: F.concat(F.lit("query="), F.substring_index(s, "=", 1)))
    scheme = F.concat(F.lit("scheme="), F.substring_index(url, "://", 1))
    return F.when(host != "", F.array_sort(F.array_distinct(F.concat(F.array(scheme), parents, segments, keys)))).otherwise(F.array().cast("array<string>"))


def parsed(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key``, url, host, path, tokens."""
    host, path = host_path(F.col("url"))
    out = pages.select(key, "url", host.alias("host"), path.alias("path"))
    return out.withColumn("tokens", url_tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")))


def mine_rules(labelled: DataFrame) -> DataFrame:
    """(items, rarest, confidence, support) from (tokens, bad); a table in the shared folder."""
    rows = labelled.where("bad is not null and size(tokens) > 0")
    rows = stage(rows.select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items"), F.col("bad").cast("long").alias("bad")), "labelled-urls")
    total, bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    schema = "items array<string>, rarest string, confidence double, support double"
    if not bad:
        return rows.sparkSession.createDataFrame([], schema)
    single = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    support = max(MIN_SUPPORT, MIN_ROWS / total)
    itemsets = FPGrowth(itemsCol="items", minSupport=min(support, 1.0), minConfidence=1.0).fit(rows.select("items")).freqItemsets
    itemsets = stage(itemsets.where(F.size("items") <= LONGEST + 1).select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_bad = itemsets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits"))
    rules = with_bad.join(itemsets, "items").select("items", (F.col("hits") / F.col("freq")).alias("confidence"), (F.col("hits") / total).alias("support"))
    rules = stage(rules.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("confidence") > bad / total)), "rules")
    shorter = rules.select(F.col("items").alias("shorter"))
    each = rules.where(F.size("items") > 1).select("items", F.explode("items").alias("gone"))
    covered = each.join(shorter, F.array_remove(F.col("items"), F.col("gone")) == F.col("shorter")).select("items").distinct()
    rules = rules.join(covered, "items", "left_anti")
    listed = rules.select("*", F.explode("items").alias("item")).join(single, "item")
    best = listed.groupBy("items").agg(F.min(F.struct("n", "item")).alias("low"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    return stage(best.select("items", F.col("low.item").alias("rarest"), "confidence", "support"), "rules")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", fixed=RULES) -> DataFrame:
    """``key``, host, path, rule, verdict, confidence (of the best mined rule that fits, else null)."""
    sets = pages.where(F.size("tokens") > 0).select("tokens").distinct()
    index = rules.select("rarest", "items", "confidence")
    found = sets.select("tokens", F.explode("tokens").alias("rarest")).join(index, "rarest")
    found = found.where(F.size(F.array_except("items", "tokens")) == 0).groupBy("tokens").agg(F.max("confidence").alias("confidence"))
    out = pages.join(found, "tokens", "left")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(fixed, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    method = F.when(F.col("confidence").isNull(), "allow").otherwise("block")
    return out.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of the pages whose path names a labelled document by its number."""
    number = F.regexp_extract("path", "([0-9]{1,18})", 1)
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return pages.select("tokens", F.when(number != "", number.cast("long")).alias("doc_id")).join(said, "doc_id").select("tokens", "bad")


def filter_urls(pages: DataFrame, labels: DataFrame, key: str = "page_id") -> DataFrame:
    pages = parsed(pages, key)
    return judge(pages, mine_rules(labelled_urls(pages, labels)), key)
