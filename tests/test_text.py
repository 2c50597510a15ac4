import pytest
from pyspark.sql import functions as F

from orderlens.functions.leaves import numeric_leaves
from orderlens.functions.text import number_tokens, plain_number, renderings, word_count
from orderlens.operators import factcheck

TEXTS = {
    "plain": "Revenue was INR 97,358.30 in 175 orders; the rate is 25.14%.",
    "dates": "From 2026-01-02 to 2026-06-29, best month 2026-03, year 2026, code 1234-567",
    "ends": "We sold 175. Then 12,000, and 3.5",
    "negative": "r = -0.088",
    "other digits": "३४५ और 42",
    "none": "nothing here",
    "empty": "",
}


EXPECTED = {
    "plain": {"97358.30", "175", "25.14"},
    "dates": {"2026", "7"},
    "ends": {"175.", "12000", "3.5"},
    "negative": {"0.088"},
    "other digits": {"३४५", "42"},
    "none": set(),
    "empty": set(),
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "text_id string, text string")


def test_tokens(texts):
    found = {r["text_id"]: r["t"] for r in texts.select("text_id", number_tokens(F.col("text")).alias("t")).collect()}
    for name in TEXTS:
        assert set(found[name]) == EXPECTED[name], name
        assert len(found[name]) == len(set(found[name]))
    assert "175." in found["ends"] and "2026" in found["dates"] and "0.088" in found["negative"]


def test_signed_tokens(texts):
    row = texts.filter("text_id = 'negative'").select(number_tokens(F.col("text"), signed=True).alias("t")).first()
    assert row["t"] == ["-0.088"]
    span = texts.limit(1).select(number_tokens(F.lit("5-10 pieces at -3.5"), signed=True).alias("t")).first()
    assert span["t"] == ["5", "10", "-3.5"]


def test_renderings_follow_python(spark):
    values = [0.0, 1.0, 2.5, 3.5, 0.125, 97358.3, 2501.9, 12345678.9, 1e9, 54.55, -0.088, 1234567890123.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", renderings(F.col("v")).alias("r")).collect():
        v = row["v"]
        assert row["r"] == [f"{v:,.2f}".replace(",", ""), f"{v:,.0f}".replace(",", ""), str(v)]
    exact = {1e-13: "0.0000000000001", 0.1234567890123456: "0.1234567890123456", 1e27: "1" + "0" * 27 + ".0", -2.5e-7: "-0.00000025", 1.25e10: "12500000000.0", 123456789.125e3: "123456789125.0"}
    rows = spark.createDataFrame([(v,) for v in exact], "v double").select("v", plain_number(F.col("v")).alias("t")).collect()
    assert {r["v"]: r["t"] for r in rows} == exact
    assert df.filter("v = 1e9").select(plain_number(F.col("v"))).first()[0] == "1000000000.0"


def test_words_follow_python_split(spark):
    samples = ["", " ", "one", " two\nwords\t", "a\x1cb　c d\x85e", "trailing \n", "a b\x0bc"]
    df = spark.createDataFrame([(s,) for s in samples], "text string")
    assert [r[0] for r in df.select(word_count(F.col("text"))).collect()] == [len(s.split()) for s in samples]


def test_both_directions(spark, texts):
    headline = spark.createDataFrame(
        [("revenue", 97358.3), ("orders", 175.0), ("rate", 25.14), ("peak", 20318.9)], "label string, value double"
    )
    ok = {(r["text_id"], r["label"]) for r in factcheck.headline_check(texts, headline).collect() if r["ok"]}
    assert ok == {("plain", "revenue"), ("plain", "orders"), ("plain", "rate")}
    scores = {r["text_id"]: r for r in factcheck.headline_score(texts, headline).collect()}
    assert (scores["plain"]["matched"], scores["plain"]["total"]) == (3, 4)
    assert scores["empty"]["matched"] == 0 and scores["empty"]["numbers"] == 0
    unsupported = {(r["text_id"], r["token"]) for r in factcheck.unsupported_numbers(texts, headline).collect()}
    # A full stop belongs to the token, so '175.' is not '175'; short tokens and years pass.
    assert unsupported == {
        ("ends", "175."), ("ends", "12000"), ("ends", "3.5"), ("negative", "0.088"), ("other digits", "३४५"),
    }


def test_an_altered_figure_is_noticed(spark):
    headline = spark.createDataFrame([("rate", 44.44)], "label string, value double")
    text = spark.createDataFrame([("x", "COD returns at 47.44%")], "text_id string, text string")
    assert not factcheck.headline_check(text, headline).first()["ok"]
    assert [r["token"] for r in factcheck.unsupported_numbers(text, headline).collect()] == ["47.44"]


def test_hot_tokens_may_be_spread(spark):
    from orderlens.operators.skew import HotKeys

    texts = spark.createDataFrame([(str(i), f"call 555 or {1000 + i}") for i in range(200)], "text_id string, text string")
    figures = spark.createDataFrame([(1005.0,), (777.0,)], "value double")
    plain = sorted(map(tuple, factcheck.unsupported_numbers(texts, figures).collect()))
    spread = factcheck.unsupported_numbers(texts, figures, hot=HotKeys(("555",), (0.5,)))
    assert sorted(map(tuple, spread.collect())) == plain
    assert len(plain) == 399


def test_leaves_cover_structs_maps_and_arrays(spark):
    df = spark.range(1).selectExpr(
        "named_struct('a', 1, 'flag', true, 'name', 'x', 'none', cast(null as int)) as s",
        "map('k', named_struct('v', 2.5D)) as m",
        "array(3, 4) as l",
        "array('t') as texts",
        "cast(null as map<string, int>) as missing",
    )
    assert {(r["path"], r["value"]) for r in numeric_leaves(df).collect()} == {
        ("s.a", 1.0), ("m.k.v", 2.5), ("l.0", 3.0), ("l.1", 4.0),
    }
