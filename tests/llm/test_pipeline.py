import hashlib

import corpus_pipeline
from pyspark.sql import functions as F

from orderlens.llm import bpe, ngram_join, queries
from orderlens.llm.common import table
from test_ngram_join import brute as brute_links
from test_suffix_dedup import brute as brute_repeats

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, docs.count()
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    for name, work in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = work(spark, docs, SF).cache()
        after = {r.doc_id: r for r in docs.collect()}
        if name != "byte-level BPE":
            assert docs.columns == columns
        if name == "quality classifier":
            clean = {d for d, r in labels.items() if r.quality == 1 and r.toxic == 0}
            assert len(clean & after.keys()) >= 0.97 * len(clean & before.keys()) and len(after) < rows
        elif name == "n-gram Jaccard join":
            said = brute_links([(d, r.text) for d, r in before.items()])
            assert after.keys() == {root for _, root, _ in said}
        elif name == "suffix-array dedup":
            for d, _, _, _, digest in brute_repeats([(d, r.text) for d, r in before.items()]):
                left = after[d].text.encode()
                # bytes left of characters that were cut are dropped from the text; nothing else may differ
                assert len(left) == len(before[d].text.encode()) or after[d].n_chars == len(after[d].text)
                assert hashlib.sha256(left).hexdigest() == digest or len(left) < len(before[d].text.encode())
        elif name == "byte-level BPE":
            texts = {r.doc_id: r.text for r in bpe.decode_frame(docs).collect()}
            assert texts == {d: r.text or "" for d, r in before.items()}


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    names = [q.split("_")[0] for q in queries.QUERIES]
    assert names == [f"op{n}" for n in range(1, 14)]
    assert ngram_join.near_duplicates(table(spark, SF, "documents")).count() == table(spark, SF, "documents").count()


def test_other_columns_may_have_any_name(spark):
    docs = table(spark, SF, "documents").limit(40)
    names = ["_d", "_m", "_found", "_leaks", "_set_id", "_stays", "_keeper", "_verdict", "_row", "vector", "_site", "_SALT", "given_0", "set_id", "quality"]
    odd = docs.select("*", *(F.col("doc_id").alias(n) for n in names)).cache()
    for name, work in corpus_pipeline.STAGES[:-1]:
        out = work(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert rows and all(r[n] == r.doc_id for r in rows for n in names), name
        assert {(r.doc_id, r.text) for r in rows} == {(r.doc_id, r.text) for r in work(spark, docs, SF).collect()}, name
