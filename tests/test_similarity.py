"""N-grams, nearest references and diverse selection against brute force."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from curatrix.operators import ngrams as N
from curatrix.operators import similarity as S

TEXTS = ["The cat  sat\n\non it", "the cat sat on", "zq", "ünï 😀cøde 😀x", "aaaaaaa", "", "nul\x00l a\x00", "The cat  sat\n\non it"]


def plain(text):
    import re
    text = re.sub(r"\s{2,}", " ", text.lower())
    return Counter(text[i:i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1))


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_ngrams_equal_dictionary_counts(spark):
    got = {(r["id"], r["term"]): r["tf"] for r in N.char_ngrams(docs(spark), "id", "text").collect()}
    assert got == {(i, t): n for i, text in enumerate(TEXTS) for t, n in plain(text).items()}
    vocab = {r["term"]: (r["df"], r["total"]) for r in N.text_vocab(docs(spark), "text", 2).collect()}
    df, total = Counter(), Counter()
    for text in TEXTS:
        df.update(plain(text).keys())
        total.update(plain(text))
    assert vocab == {t: (n, total[t]) for t, n in df.items() if n >= 2}
    same = {r["term"]: (r["df"], r["total"]) for r in N.fit_vocab(N.char_ngrams(docs(spark), "id", "text")).collect()}
    assert same == vocab


def test_wide_alphabets_fall_back(spark):
    wide = "".join(chr(0x4E00 + i) for i in range(9000))
    parts = list(N.count_windows([wide, "abcabc"], 3, 5))
    terms = Counter()
    for rows, counts, words in parts:
        for r, c, w in zip(rows, counts, words.to_pylist()):
            terms[(int(r), w)] += int(c)
    assert terms[(1, "abc")] == 2 and terms[(0, wide[:5])] == 1 and len(terms) == sum(9000 - n + 1 for n in (3, 4, 5)) + 3 + 3 + 2
    known = N.TermTable([wide[:5], wide, "abc"][:1] + ["abc", wide[100:103]])
    rows, ix, counts = known.count([wide, "abcabc"], 3, 5)
    assert list(zip(rows.tolist(), ix.tolist(), counts.tolist())) == [(0, 0, 1), (0, 2, 1), (1, 1, 2)]


def test_vectors_equal_counted_weights(spark):
    vectors, terms = N.fit_tfidf_rows(docs(spark), "id", "text", 2)
    known = {r["term"]: (r["ix"], r["idf"]) for r in terms.collect()}
    rows = vectors.collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = sorted((known[t][0], n * known[t][1]) for t, n in plain(TEXTS[r["id"]]).items() if t in known)
        norm = np.sqrt(sum(w * w for _, w in want)) or 1.0
        assert r["ix"] == [i for i, _ in want] and np.allclose(r["w"], [w / norm for _, w in want])
    long = N.tfidf(docs(spark), "id", "text", N.text_vocab(docs(spark), "text"), len(TEXTS))
    lengths = long.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in lengths)


def vectors(spark, n, seed, key="id"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    x[1] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, list(range(6)), row.tolist(), float(i * 7919 % 101)) for i, row in enumerate(x)]
    return x, spark.createDataFrame(rows, f"{key} long, ix array<int>, w array<double>, score double")


def test_nearest_in_one_block_and_in_many(spark):
    x, q = vectors(spark, 60, 1)
    y, r = vectors(spark, 40, 2, "ref")
    sims = np.round(x @ y.T, S.TIE_PLACES)
    want = {i: sorted(range(40), key=lambda j: (-sims[i, j], j))[:10] for i in range(60)}
    for block_cells in (10**6, 50):
        found = S.nearest(q, r, "id", "ref", 10, block_cells).collect()
        got = {}
        for row in sorted(found, key=lambda row: row["rank"]):
            got.setdefault(row["id"], []).append(row["ref_id"])
        assert got == want
    summary = S.knn_summary(q, r, "id", "ref").filter("id = 5").first()
    assert abs(summary["top10_similarity"] - sims[5, want[5]].mean()) < 1e-9


def test_no_shared_term_counts_as_zero(spark):
    q = spark.createDataFrame([(1, [9], [1.0]), (2, [], [])], "id long, ix array<int>, w array<double>")
    r = spark.createDataFrame([(i, [i], [1.0]) for i in range(3)], "ref long, ix array<int>, w array<double>")
    for row in S.knn_summary(q, r, "id", "ref").collect():
        assert (row["max_similarity"], row["top5_similarity"], row["top10_similarity"], row["nearest_id"]) == (0.0, 0.0, 0.0, 0)


def greedy(x, score, k, limit):
    order = sorted(range(len(x)), key=lambda i: (-score[i], i))
    chosen, best = [], {}
    for i in order:
        sims = [float(x[i] @ x[j]) for j in chosen]
        best[i] = max(sims, default=0.0)
        if len(chosen) < k and (not sims or max(sims) <= limit):
            chosen.append(i)
    return chosen, best


def test_diverse_shortlist_equals_greedy_walk(spark):
    x, df = vectors(spark, 300, 4)
    score = [i * 7919 % 101 for i in range(300)]
    for k, limit, chunk in ((25, 0.5, 200), (25, 0.5, 3), (400, 0.3, 50)):
        chosen, best = greedy(x, score, k, limit)
        got = {r["id"]: r for r in S.diverse_shortlist(df, "id", k, limit, chunk).collect()}
        assert {i for i, r in got.items() if r["selected"]} == set(chosen) and len(got) == 300
        assert all(abs(got[i]["similarity_to_selected"] - best[i]) < 1e-9 for i in got)
        picked = x[chosen] @ x[chosen].T - np.eye(len(chosen))
        assert picked.max() <= limit + 1e-12


def test_minmax_and_composite(spark):
    df = spark.createDataFrame([(0.0, 3.0, None), (2.0, 3.0, None)], "a double, b double, c double")
    out = S.minmax(df, ["a", "b", "c"]).collect()
    assert [(r["a_scaled"], r["b_scaled"], r["c_scaled"]) for r in out] == [(0.0, 0.5, None), (1.0, 0.5, None)]
    score = S.composite(df, {"a": 0.4, "b": 0.3, "c": 0.3}).orderBy("a").collect()
    assert np.allclose([r["composite_score"] for r in score], [0.5 * 3 / 7, 4 / 7 + 0.5 * 3 / 7])
