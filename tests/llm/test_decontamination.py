"""Positional index against brute force."""

import random
import re

import pytest

from curatrix.llm import decontamination as dc

SCHEMA = "doc_id long, text string, hits string, items string, position long"
ITEMS = "item_id long, text string, doc_id string"


def brute_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def windows(text, width):
    w = brute_words(text)
    return [w[i:i + width] for i in range(max(1, len(w) - width + 1))] if w else []


def brute(docs, items, width, slop):
    out = []
    for i, text in docs:
        w, hit, exact, near = brute_words(text), set(), set(), set()
        for name, item in items:
            name = "" if name is None else str(name)
            for window in windows(item, width):
                n = len(window)
                for s in range(len(w) - n + 1):
                    if w[s:s + n] == window:
                        hit |= set(range(s, s + n))
                        exact.add(name)
                for s in range(-n - slop, len(w)):
                    stretch = w[max(0, s):s + n + slop]
                    if all(stretch.count(t) >= window.count(t) for t in window):
                        near.add(name)
        out.append((i, len(w), len(hit), sorted(exact), sorted(near)))
    return sorted(out, key=str)


def case(seed=0):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("a b c d e F G".split()) for _ in range(n))
    items = [(k, say(rng.randint(1, 7))) for k in range(12)] + [(12, None), (13, "..."), (None, "Zz"), (14, "b a"), (15, "b a"), (14, "b a")]
    docs = [(k, say(rng.randint(0, 60))) for k in range(30)] + [(30, None), (31, ""), (31, "b, A!"), (31, "b, A!"), (None, "zZ éa b"), (32, "q " * 40_000 + "b a")]
    docs += [(33, "a"), (34, "b"), (35, "é-b.a:é")]
    return docs, items


def rows(frame):
    hits = lambda r: sum(s["end"] - s["start"] for s in r["hits"])
    return sorted(((r["doc_id"], r["n_words"], hits(r), list(r["items"]), list(r["near_items"])) for r in frame.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"block_bytes": 40}])
def test_against_brute_force(spark, options):
    docs, items = case()
    frame = spark.createDataFrame([(i, t, "x", None, 1) for i, t in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = dc.matches(frame, bench, width=4, slop=2, **options)
    assert rows(got) == brute(docs, items, 4, 2)


def test_digest_and_decontaminate(spark):
    docs = [(1, "one two three four"), (2, "one two x three"), (2, None), (3, "")]
    frame = spark.createDataFrame([(i, t, "x", None, 1) for i, t in docs], SCHEMA)
    bench = spark.createDataFrame([(10, "two three", "x"), (9, "One two", "x")], ITEMS)
    got = dc.matches(frame, bench, width=10).select("doc_id", dc.n_hit().alias("n"), dc.items_digest().alias("d"))
    import hashlib
    assert sorted((r["doc_id"], r["n"], r["d"]) for r in got.collect()) == sorted(
        (i, n, hashlib.sha256(s.encode()).hexdigest()) for i, n, s in [(1, 3, "10,9"), (2, 2, "9"), (2, 0, ""), (3, 0, "")])
    kept = dc.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, None), (3, "")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", None, 1)], SCHEMA)
    bench = spark.createDataFrame([(1, "a b", "x")], ITEMS)
    assert dc.matches(docs.limit(0), bench).count() == 0
    got = dc.matches(docs, bench.limit(0)).first()
    assert (got["n_words"], got["hits"], got["items"]) == (2, [], [])
    assert dc.decontaminate(docs, bench.limit(0)).count() == 1
