"""Rules and vocabulary of the URL filter."""

import random
import re

import pytest

from curatrix.llm import url_filter as uf

WORDS = {"bad": 1.0, "bad-bet": 1.0, "free": 0.5, "bet": 0.5, "win": 0.4}


@pytest.mark.parametrize("url, host, path", [
    (None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://", "", ""), ("HTTP://A.Éx.Net/P?q#f", "a.Éx.net", "/P"),
    ("http://a.b", "a.b", ""), ("http://a.b?x=/y", "a.b", ""), ("http://a.b#/y?z", "a.b", ""), ("x://y://z/w", "y:", "//z/w"),
    ("http://a.b/c#d?e", "a.b", "/c"), ("http://a.b:80/", "a.b:80", "/"),
])
def test_split(url, host, path):
    assert uf.split_url(url) == (host, path)


@pytest.mark.parametrize("url, rule, verdict", [
    ("http://x.net/a", "net/", "block"), ("http://example.net/en/1", "example.net/en/", "allow"), ("http://m.example.net/en/1", "example.net/en/", "allow"),
    ("http://myexample.net/en/1", "net/", "block"), ("http://a.net", None, None), ("http://example.com/de/", "example.com/de/", "block"),
    ("http://example.com/en/", None, None), ("http://a.org/fr/x", "org/fr/", "allow"), ("http://org.com/fr/x", None, None),
])
def test_rules(url, rule, verdict):
    assert uf.longest_rule(*uf.split_url(url), uf.RULES) == (rule, verdict)


def test_counts_against_expressions():
    rng = random.Random(1)
    counter = uf.Counter(WORDS)
    for _ in range(2000):
        url = "".join(rng.choice(["bad", "-", "bet", "free", "/", "x", "é", "Win", "9"]) for _ in range(rng.randint(0, 9)))
        low = url.translate(uf.LOWER)
        want = {t: len(re.findall(f"(?<![a-z0-9])(?={t}(?![a-z0-9]))", low)) for t in WORDS}
        assert counter.count(url) == {t: n for t, n in want.items() if n}


def test_judge(spark):
    rows = [(1, "http://a.com/bad", "v"), (2, "http://a.com/badly", "v"), (3, "http://free.com/free", None), (4, "http://free.com/win", "v"),
            (5, "http://a.net/ok", "v"), (6, "http://a.org/fr/bad", "v"), (7, None, "v"), (8, "free bet", "v"), (8, "free bet", "v"), (None, "", "v"),
            (9, "http://a.com/" + "x/" * 200_000 + "bad", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = uf.judge(pages, vocabulary=WORDS)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict", "strict_hits", "soft_terms", "weight"]
    want = {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "block", None: "allow", 9: "block"}
    result = got.collect()
    assert len(result) == len(rows) and all(want[r["page_id"]] == r["verdict"] for r in result)
    three = next(r for r in result if r["page_id"] == 3)
    assert (three["soft_terms"], three["weight"]) == (1, 1.0)
    assert uf.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in uf.judge(pages.where("page_id < 5"), rules=[], vocabulary={}).collect()} == {"allow"}
