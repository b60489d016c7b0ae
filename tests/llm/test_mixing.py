"""Posteriors, nonnegative rates and copies."""

import numpy as np
import pytest

from curatrix.llm import mixing


def members(spark, rows):
    return spark.createDataFrame(rows, "tokens long, posterior array<double>")


def solved(rows, mixed):
    p = np.array([r[1] for r in rows])
    tokens = np.array([r[0] for r in rows], float)
    r = mixed.rates(p)
    return r, (tokens * r) @ p


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.2, 0.3, 0.5], 400)
    return [(int(t), [float(x) for x in q]) for t, q in zip(rng.integers(0, 900, 400), p)]


def test_targets_are_met(spark, rows):
    mixed = mixing.fit_rates(members(spark, rows).repartition(3), ("a", "b", "c"), {"a": 0.5, "b": 0.3, "c": 0.2}, total=1e5, tolerance=1e-4, max_steps=200)
    r, expected = solved(rows, mixed)
    assert (r >= 0).all()
    assert np.allclose(expected, mixed.expected)
    assert np.abs(expected - np.array([5e4, 3e4, 2e4])).max() <= 2e-4 * 1e5


def test_least_squares_where_the_targets_are_out_of_reach(spark):
    rows = [(10, [0.5, 0.5])] * 4
    mixed = mixing.fit_rates(members(spark, rows), ("a", "b"), {"a": 1.0}, total=100.0, max_steps=100, tolerance=1e-9)
    r, expected = solved(rows, mixed)
    # min (x - 100)^2 + x^2 over x = both totals gives 50
    assert np.allclose(expected, [50, 50], atol=0.5) and np.allclose(r, r[0])


def miss(rows, targets, r):
    """Squared misses weighed by the tokens at hand, as minimised."""
    p = np.array([x[1] for x in rows])
    tokens = np.array([x[0] for x in rows], float)
    return float((((tokens * r) @ p - targets) ** 2 / (tokens @ p)).sum())


def test_lower_bound(spark, rows):
    """Least squares under rates of at least one: as good as a long run of plain projected steps in NumPy."""
    mixed = mixing.fit_rates(members(spark, rows), ("a", "b", "c"), {"a": 1, "b": 1, "c": 1}, lower=1.0, max_steps=100)
    r, expected = solved(rows, mixed)
    assert (r >= 1).all() and np.allclose(expected, mixed.expected)
    p = np.array([x[1] for x in rows])
    tokens = np.array([x[0] for x in rows], float)
    best = np.ones(len(rows))
    for _ in range(20_000):
        gap = ((tokens * best) @ p - np.array(mixed.targets)) / (tokens @ p)
        best = np.maximum(1.0, best - 0.3 * p @ gap)
    reached, least, at_start = (miss(rows, mixed.targets, x) for x in (r, best, np.ones(len(rows))))
    assert reached - least <= 0.002 * (at_start - least)
    far = mixing.fit_rates(members(spark, rows), ("a", "b", "c"), {"a": 1, "b": 1, "c": 1}, lower=1.0, total=1e6, max_steps=100)
    r, expected = solved(rows, far)
    assert (r >= 1).all() and np.abs(expected - 1e6 / 3).max() <= 2e-3 * 1e6


def test_unknown_domains_and_no_tokens(spark):
    none = mixing.fit_rates(members(spark, []), ("a",), {"a": 1.0})
    assert none.steps == () and none.rates(np.ones((2, 1))).tolist() == [1.0, 1.0]
    only = mixing.fit_rates(members(spark, [(10, [1.0])]), ("a",), {"zz": 1.0})
    assert only.steps == ()


def texts(spark):
    en, de = "the cat sat on that mat with this hat ", "der hund ist schön und größer als die katze "
    rows = [(i, (en if i % 3 else de) * (1 + i % 5), "x", 1.0) for i in range(60)]
    rows += [(60, None, "x", None), (61, "", "x", 1.0), (61, "", "x", 1.0), (None, en, "x", 1.0), (62, en * 5000, "x", 1.0)]
    labelled = [(i, "en" if i % 3 else "de") for i in range(0, 60, 2)] + [(None, "en"), (1, None), (62, "en"), (999, "de")]
    return (spark.createDataFrame(rows, "doc_id long, text string, domain string, rate double"),
            spark.createDataFrame(labelled, "doc_id long, domain string"))


def test_mix(spark):
    docs, labelled = texts(spark)
    rows = mixing.mix(docs, labelled, {"en": 0.5, "de": 0.5}, lower=1.0).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert abs(sum(r["posterior"]) - 1) < 1e-9 and r["rate"] >= 1 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1)
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["domains"][int(np.argmax(r["posterior"]))] == ("en" if r["doc_id"] % 3 else "de")
    total = {d: sum(r["rate"] * r["tokens"] * r["posterior"][k] for r in rows) for k, d in enumerate(rows[0]["domains"])}
    assert abs(total["en"] / sum(total.values()) - 0.5) < 0.01


def test_empty_tables(spark):
    docs, labelled = texts(spark)
    assert mixing.mix(docs.limit(0), labelled, {"en": 1.0}).count() == 0
    rows = mixing.mix(docs, labelled.limit(0), {"en": 1.0}).collect()
    assert {(r["rate"], tuple(r["domains"])) for r in rows} == {(1.0, ("",))}
