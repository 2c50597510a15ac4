import random

import numpy as np
import pytest

from orderlens.llm import bpe, token_counts


def brute(text, spans, rule):
    """Token by token and section by section."""
    coder = bpe.coder()
    begin, end = coder.spans(coder.encode(text).astype(np.int64))
    total, crossing = [0.0] * len(spans), [0] * len(spans)
    for b, e in zip(begin, end, strict=True):
        shared = [max(0, min(e, stop) - max(b, start)) for _, start, stop in spans]
        touched = [k for k, n in enumerate(shared) if n]
        for k in touched:
            crossing[k] += len(touched) > 1
        if touched and rule == "shared":
            for k in touched:
                total[k] += shared[k] / sum(shared)
        elif touched:
            total[max(touched, key=lambda k: (shared[k], -k)) if rule == "majority" else touched[0]] += 1
    return [(*s, round(t, 9), c, len(begin)) for s, t, c in zip(spans, total, crossing, strict=True)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_match_brute_force(spark, rule):
    draw = random.Random(4)
    rows, want = [], []
    for i in range(40):
        text = "".join(draw.choice(["token", " ization", "é", "🙃", "\n\n", " a", "1234", "x"]) for _ in range(draw.randint(0, 40)))
        cuts = sorted(draw.sample(range(len(text) + 1), min(len(text) + 1, draw.choice([2, 4, 6]))))
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[::2], cuts[1::2], strict=False))]
        rows.append((i, text, [{"section": s, "start": a, "stop": b} for s, a, b in spans]))
        want += [(i, *r) for r in brute(text, spans, rule)]
    docs = spark.createDataFrame([*rows, (99, None, None)], "doc_id long, text string, spans array<struct<section:int,start:int,stop:int>>")
    got = [(r.doc_id, r.section, r.start, r.stop, round(r.n_tokens, 9), r.n_crossing, r.text_tokens) for r in token_counts.count_tokens(docs, "spans", rule=rule).collect()]
    assert sorted(got) == sorted(want)


def test_lines(spark):
    texts = ["one\ntwo words\n\n last", "", None, "\n", "no feed"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(4, "no feed")], "doc_id long, text string")
    rows = token_counts.count_tokens(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.section, r.start, r.stop))
    assert sorted(by[0]) == [(0, 0, 4), (1, 4, 14), (2, 14, 15), (3, 15, 20)] and by[3] == [(0, 0, 1)] and len(by[4]) == 2 and set(by) == {0, 3, 4}
    assert sum(r.n_tokens for r in rows if r.doc_id == 0) == next(r.text_tokens for r in rows if r.doc_id == 0)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, rule="last")
