import pytest

from orderlens.llm import url_filters


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


URLS = [
    None, "", "no scheme", "http://", "http://A.Org", "http://a.org/", "https://x.EXAMPLE.org/es/1?q=1", "http://example.org/en/1#x", "http://example.org/en/2",
    "http://badexample.org/es/", "http://b.com/fr/?u=http://c.com/de/", "http://b.com/de/x/y.html", "http://b.com?x=/de/", "ftp://É.com/a\nb", "http://u://v/w",
]


def test_hosts_paths_and_fixed_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, None)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in url_filters.filter_urls(pages, labels).collect()}
    for i, url in enumerate(URLS):
        assert (rows[i].host, rows[i].path) == split(url), url
    said = {i: (r.rule, r.verdict) for i, r in rows.items()}
    assert said[4] == (None, "allow") and said[5] == ("org/", "allow")
    assert said[6] == ("example.org/es/", "block") and said[7] == ("example.org/en/1", "block") and said[8] == ("org/", "allow")
    assert said[9] == ("org/", "allow") and said[10] == ("com/fr/", "allow") and said[11] == ("com/de/", "block") and said[12] == (None, "allow")


@pytest.fixture(scope="module")
def mined(spark):
    pages, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        pages.append((i, f"http://{'spam' if bad or i % 8 == 1 else 'site'}.net/{'win' if bad else 'read'}/{i}{'?ref=x' if i % 3 else ''}"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    pages.append((1000, "http://spam.net/other/7777777"))
    return spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([*labels, labels[0], (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_rules_block_what_the_labels_say(mined):
    pages, labels = mined
    rows = {r.page_id: r.verdict for r in url_filters.filter_urls(pages, labels).collect()}
    assert all(rows[i] == ("block" if i % 4 == 0 else "allow") for i in range(400) if i % 8 != 1)


def test_index_finds_what_a_scan_finds(mined):
    pages, labels = mined
    pages = url_filters.parsed(pages)
    rules = url_filters.mine_rules(url_filters.labelled_urls(pages, labels))
    kept = [(set(r["items"]), r.confidence) for r in rules.collect()]
    assert kept and not any(a < b for a, _ in kept for b, _ in kept if len(b) == len(a) + 1)
    got = {r.page_id: r.confidence for r in url_filters.judge(pages, rules).collect()}
    for r in pages.collect():
        assert got[r.page_id] == max((c for items, c in kept if items <= set(r.tokens)), default=None)


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert url_filters.filter_urls(spark.createDataFrame([], "page_id long, url string"), labels).count() == 0
