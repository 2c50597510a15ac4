"""The registered queries of this package: each operator over its whole table, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import bpe, conversation_repair, decontaminate, lexical_search, license_scan, maxent_lm, ngram_join, quality_classifier, quality_rules, speculative_bpe, suffix_dedup, token_counts, url_filters
from orderlens.llm.common import table


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filters.filter_urls(table(spark, folder, "pages").select("page_id", "url"), table(spark, folder, "labels"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The licenses in every document."""
    return license_scan.scan(table(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality, toxicity and verdict of every document."""
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    return bpe.encode_decode(table(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.count_tokens(table(spark, folder, "documents"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document without the 100-byte strings that start earlier."""
    return suffix_dedup.removed_bytes(table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items in every document."""
    return decontaminate.leaked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's near-duplicate class and its number of links."""
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op10_maxent_lm(spark: SparkSession, folder: str) -> DataFrame:
    """The language model's score of every document, learned from four fifths of them."""
    return maxent_lm.score(table(spark, folder, "documents"))


def op11_speculative_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document by speculate and verify, as digests."""
    return speculative_bpe.encode_decode(table(spark, folder, "documents"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation, damaged by a checksum before."""
    return conversation_repair.audit(conversation_repair.damage(table(spark, folder, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_license_scan": op2_license_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_ngram_join": op9_ngram_join,
    "op10_maxent_lm": op10_maxent_lm,
    "op11_speculative_bpe": op11_speculative_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_repair": op13_conversation_repair,
}

#: Only ranked search can be said in SQL: the others learn, hash or encode. tests/llm compares them with brute force.
ORACLE: dict[str, str] = {
    "op12_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, number, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT doc_id, text, row_number() OVER () AS number FROM documents)
        ), counted AS (
            SELECT number, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY number, term
        ), sizes AS (
            SELECT number, sum(tf)::BIGINT AS n FROM counted GROUP BY number
        ), whole AS (
            SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes
        ), shares AS (
            SELECT term, count(*) AS df FROM counted GROUP BY term
        ), items AS (
            SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
            FROM benchmark
        ), scored AS (
            SELECT item_id, text, number, any_value(doc_id) AS doc_id,
                   sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                       * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
            FROM items JOIN counted USING (term) JOIN shares USING (term) JOIN sizes USING (number) CROSS JOIN whole
            GROUP BY item_id, text, number
        )
        SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
        FROM scored WHERE score > 0
        QUALIFY rank <= 10
    """,
}
