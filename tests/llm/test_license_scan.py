import re

from orderlens.llm import license_scan


def brute(text, templates):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    out = set()
    for name, template in templates.items():
        own = re.findall(r"[a-z0-9\x80-\U0010ffff]+", template.lower())
        n = min(5, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        block = 1 << max(len(grams) - 1, 0).bit_length()
        for at in range(0, max(len(words) - n + 1, 0), block):
            held = {tuple(words[i : i + n]) for i in range(at, min(at + 2 * block, len(words) - n + 1))}
            if 5 * len(grams & held) >= 4 * len(grams):
                out.add(name)
    return out


def test_matches_brute_force(spark):
    names = list(license_scan.TEMPLATES)
    docs = [f"{'filler ' * i}{license_scan.TEMPLATES[n]}{' tail' * (i % 3)}" for i, n in enumerate(names)]
    for i, n in enumerate(names):  # a word of 20 changed, and a half
        own = license_scan.TEMPLATES[n].split()
        docs.append(" ".join("changed" if k and k % 20 == 0 else w for k, w in enumerate(own)) + " x" * i)
        docs.append("y " * i + " ".join(own[: len(own) // 2]))
    docs += [None, "", " \n", "All Rights  reserved!", "all rights", " ".join(license_scan.TEMPLATES.values()), "word " * 5000 + license_scan.TEMPLATES["GPL-3.0"]]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    got = {(r.doc_id, r.license) for r in rows}
    assert len(rows) == len(got)
    assert got == {(i, n) for i, d in enumerate(docs) for n in brute(d, license_scan.TEMPLATES)}
    assert all(r.share >= 0.8 for r in rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "All rights reserved"), (1, "All rights reserved"), (None, "all rights reserved")], "doc_id long, text string")
    assert license_scan.scan(docs).count() == 3
    assert license_scan.scan(docs, {}).count() == 0 and license_scan.scan(docs.limit(0)).count() == 0
    assert license_scan.scan(docs, {"none": " "}).count() == 0


def test_bands_meet_the_target():
    assert 1 - (1 - 1 / 5) ** license_scan.BANDS > 0.9995
