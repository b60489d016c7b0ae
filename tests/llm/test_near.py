"""The near-duplicate operator against brute-force Jaccard similarity of five-word shingles."""

import random
import re

from pyspark.sql import functions as F

from curatrix.llm import near
from curatrix.llm.common import located, save
from curatrix.llm.exact_dedup import deduplicate as exact
from tests.llm.test_simhash import classes


def STAGE(spark, docs, folder):  # noqa: N802
    return near.deduplicate(docs)


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(sets):
    """Pairs of ids at Jaccard 0.8 or more; sets without a common shingle cannot be."""
    of, out = {}, []
    for i, s in sets.items():
        for x in s or [""]:
            of.setdefault(x, []).append(i)
    for pair in {(a, b) for ids in of.values() for a in ids for b in ids if a < b}:
        x, y = (sets[i] for i in pair)
        if 5 * len(x & y) >= 4 * len(x | y):
            out.append(pair)
    return out


def expected(texts):
    root = classes(brute_links({i: shingles(t) for i, t in texts.items()}), texts)
    return {min(m for m in texts if root[m] == r) for r in set(root.values())}


def made():
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 9999)}"
    texts = {}
    passage = [word() for _ in range(60)]
    for group in range(25):
        base = [word() for _ in range(rng.randint(3, 160))]
        for copy in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = word()
            texts[group * 10 + copy] = " ".join(words + (passage if group % 3 == 0 else []))
    source = [word() for _ in range(200)]
    for i in range(60):  # each near the source, most of them less near one another
        words = list(source)
        for at in rng.sample(range(5, 195), 3):
            words[at] = word()
        texts[1000 + i] = " ".join(words)
    texts |= {2000: None, 2001: "", 2002: "One two", 2003: "one TWO", 2004: " ".join(passage), 2005: "long " * 9000}
    return texts


def test_every_pair_of_similarity_eight_tenths(spark):
    texts = made()
    rows = [(i, t, "en", "s", 0) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = STAGE(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == expected(texts)


def test_stage_on_the_given_table(spark):
    docs = save(exact(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), "test-near")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = expected(texts)
    assert len(want) < len(texts)
    assert {r["doc_id"] for r in STAGE(spark, docs, "").collect()} == want


def test_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e f"), (3, "A b c d e f"), (3, "a b c d e f"), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in STAGE(spark, docs, "").collect()) == [(0, "alone"), (3, "a b c d e f")]
    assert STAGE(spark, docs.limit(0), "").count() == 0


def test_texts_of_shared_passages_make_few_pairs(spark):
    """Every text has 7 of 16 passages; almost no pair is a link, and few pairs are verified."""
    rng = random.Random(5)
    passages = [" ".join(f"p{i}w{rng.randrange(10**6)}" for _ in range(20)) for i in range(16)]
    texts = {i: " ".join(passages[j] for j in sorted(rng.sample(range(16), 7))) for i in range(300)}
    docs = located(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    rows = save(near.signatures(docs), "templates")
    postings = rows.select("key", "n", F.xxhash64("digest").alias("sign"), F.explode("bands").alias("band"))
    star = near.star_pairs(postings)
    rest = near.rest_pairs(postings, rows, spark.createDataFrame([], "u long, root long"))
    assert star.count() + rest.count() < 0.05 * 300 * 299 / 2
    assert {r["doc_id"] for r in STAGE(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "").collect()} == expected(texts)


def test_frames_that_multiply_rows(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    want = expected({r["doc_id"]: r["text"] for r in docs.collect()})
    for frame in (twice, docs.join(docs.select("doc_id", F.lit(1).alias("one")), "doc_id"), docs.unionByName(docs)):
        assert sorted(r["doc_id"] for r in STAGE(spark, frame, "").collect()) == sorted(want)
