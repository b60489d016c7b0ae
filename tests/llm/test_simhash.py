"""Fingerprints, grid links and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from curatrix.llm import simhash
from curatrix.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, members):
    parent = {m: m for m in members}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {m: find(m) for m in members}


def close(values, distance=4):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if bin(a ^ b).count("1") <= distance]


def flip(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("text", ["", "one", "A b C", "a b c d", "É ß x\ty\x0bz W", "the cat sat on the mat " * 700, "x " * 5])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(1)
    values = [rng.getrandbits(64) for _ in range(50)] + [0, (1 << 64) - 1]
    counts = lambda v: [(v >> s & 1) + (v >> s + 1 & 1) for s in range(0, 64, 2)]
    rows = spark.createDataFrame([(signed(v),) for v in values], "fp long").select("fp", simhash._unary().alias("u")).collect()
    unary = {r["fp"]: r["u"] for r in rows}
    for a in values:
        for b in values:
            manhattan = sum(abs(x - y) for x, y in zip(counts(a), counts(b)))
            assert bin((unary[signed(a)] ^ unary[signed(b)]) & (1 << 64) - 1).count("1") == manhattan <= bin(a ^ b).count("1")


@pytest.mark.parametrize("groups", [6, 7])
def test_every_close_pair_shares_a_cell(groups):
    rng = random.Random(groups)
    masks = [m & (1 << 64) - 1 for m in simhash.grid_masks(groups)]
    for _ in range(300):
        a = rng.getrandbits(64)
        b = flip(rng, a, rng.randint(0, 4))
        u, v = _unary_int(a), _unary_int(b)
        assert any(u & m == v & m for m in masks)


def _unary_int(v):
    odd, high = 0x5555555555555555, v >> 1
    return ((v & high & odd) << 1) | ((v | high) & odd)


def test_links_keep_components(spark):
    rng = random.Random(3)
    values = {0}
    for _ in range(40):
        seed = rng.getrandbits(64)
        values |= {seed} | {flip(rng, seed, rng.randint(1, 5)) for _ in range(8)}
    values = sorted(values)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in simhash.links(frame).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in edges)
    assert classes(edges, values) == classes(close(values), values)


def test_large_cells_are_split_into_block_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "CELL_BLOCK", 40)
    rng = random.Random(5)
    seed = rng.getrandbits(64)
    values = list({flip(rng, seed, rng.randint(0, 6)) for _ in range(150)})
    fps = sorted(signed(v) for v in values)
    batch = pa.RecordBatch.from_arrays([pa.array([9] * len(fps)), pa.array(fps)], names=["cell", "fp"])
    rows = [r for b in simhash._link_cells(4)([batch]) for r in b.to_pylist()]
    assert rows and all(r["cell"] == 9 for r in rows)
    units = sorted((r["cell"], r["i"], r["j"], r["a"]) for r in rows)
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*units)], names=["cell", "i", "j", "fp"])
    edges = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for b in simhash._link_blocks(4)([batch]) for r in b.to_pylist()]
    assert classes(edges, values) == classes(close(values), values)


def test_forest_has_at_most_one_edge_per_member():
    fps = np.arange(16, dtype=np.uint64)
    assert len(simhash.forest(fps, 4)) == 15


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (1, 0), (200, 201)]
    members = {v for e in edges if e[0] != e[1] for v in e}
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes([(max(e), min(e)) for e in edges], members)
    assert len({(got[m], want[m]) for m in members}) == len(set(want.values())) == len(set(got.values()))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    rows = [(20, " ".join(base))]
    for i in range(12):
        copy = list(base)
        copy[rng.randrange(120)] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(40 + i, " ".join(f"v{rng.randint(0, 999)}" for _ in range(60))) for i in range(10)]
    rows += [(60, None), (61, ""), (62, " \t"), (63, "one"), (64, "one"), (64, "one"), (None, "one"), (None, "alone"), (65, "long " * 50_000)]
    return rows


def test_cluster_and_deduplicate(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id long, text string, fp long, component_id string, size long")
    got = simhash.cluster(docs.repartition(4)).collect()
    fps = sorted({brute_fingerprint(t) for _, t in rows})
    root = classes(close(fps), fps)
    ids = {}
    for i, t in rows:
        ids.setdefault(root[brute_fingerprint(t)], []).append(i)
    want = sorted(((i, brute_fingerprint(t), min((x for x in ids[root[brute_fingerprint(t)]] if x is not None), default=None),
                    len(ids[root[brute_fingerprint(t)]])) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"], r["n_rows"]) for r in got), key=str) == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(ids)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.cluster(docs).count() == 0
    assert simhash.deduplicate(docs).count() == 0


def test_groups_grow_with_the_number_of_fingerprints():
    assert [simhash.group_count(n) for n in (0, 10**5, 10**7, 10**9)] == sorted(simhash.group_count(n) for n in (0, 10**5, 10**7, 10**9))
    assert simhash.group_count(10**9) > simhash.group_count(10**3)
