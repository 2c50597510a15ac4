import re
from collections import Counter

from orderlens.llm import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(spans)
    covered = {j for i, s in enumerate(spans) if often[s] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \n\t\x0b ", "one", "a b c d e f g h a b c d e f g h", "x " * 40, "é ñ\x0bü #*$%&|<> \x1c \x85 \u3000 end",
    "same line\nsame line\n\n \n \nsame line ", "a b c d e f g h i j a b c d e f g h z a b c d e f g h i j", "\n".join(f"w{i} " * 9 for i in range(9)) + "\nw0 " * 3,
    " ".join(f"w{i % 50}" for i in range(2000)), "lone 𝔘 pair",
]


def test_statistics_match_plain_python(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "x y")], "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in quality_rules.COUNTS) for r in quality_rules.statistics(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)} | {None: brute("x y")}


def prose(i):
    return " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(60))


def test_list_rejects_junk_and_keeps_clean(spark):
    docs = [(i, prose(i)) for i in range(300)] + [(300 + i, " ".join(w + "###" for w in prose(i).split())) for i in range(100)]
    docs += [(400 + i, prose(900 + i).upper() + "!!") for i in range(100)]
    labels = [(d, int(d < 300), 0) for d, _ in docs if d % 2] + [(1, None, 0), (None, 0, 0)]
    out = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert all(kept[d] for d in range(300)) and not any(kept[d] for d in range(300, 500))


def test_base_empty_tables_and_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, prose(1)), (1, prose(1)), (2, "too short"), (3, "a b c d e f g h " * 9), (None, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.base_failed, r.kept) for r in quality_rules.judge(docs, empty).collect()))
    assert rows == [(0, True, False), (1, False, True), (1, False, True), (2, True, False), (3, True, False)]
    assert quality_rules.judge(docs.limit(0), empty).count() == 0
