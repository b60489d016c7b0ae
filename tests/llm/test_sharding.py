import zlib
from collections import Counter, defaultdict

import pytest

from curatrix.llm import sharding


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_places_sizes_and_checksums(spark, tmp_path):
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    rows = sharding.shard(docs, str(tmp_path / "map")).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    held = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        held[r["shard"]].append(r)
    loads = [sum(r["size"] for r in held[s]) for s in range(8)]
    assert max(loads) - min(loads) <= min(r["size"] for r in rows) + 1000
    for own in held.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    of_slot = {(r["virtual_slot"], r["shard"]) for r in rows}
    assert len(of_slot) == len({s for s, _ in of_slot})


def test_nulls_copies_long_texts_and_clashing_columns(spark, tmp_path):
    rows = [(None, None, "a", 1), (None, "text", "b", 2), (1, "", "c", 3), (1, "", "c", 3), (1, "other", "d", 4), (2, "ä" * 100_000, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    got = sharding.shard(docs, str(tmp_path / "map"), shards=3).collect()
    assert Counter(r["size"] for r in got) == Counter([1, 5, 1, 1, 6, 200_001])
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    of = sharding.load(spark, str(tmp_path / "map"))
    sharding.write_shards(docs, of, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == ["doc_id", "shard", "shard_", "slot", "text"]
    assert Counter((r["doc_id"], r["shard"]) for r in back.collect()) == Counter((r["doc_id"], r["shard"]) for r in got)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(docs, str(tmp_path / "map")).count() == 0
    assert sharding.load(spark, str(tmp_path / "map")).shards == 8


def test_one_key_with_a_third_of_all_rows(spark, tmp_path):
    rows = [(5 if k % 3 == 0 else k, f"text {k}") for k in range(900)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "map"), shards=4).collect()
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1 and len(got) == 900


def test_versions(spark, tmp_path):
    path = str(tmp_path / "map")
    weights = [(k * 7919) % 1000 + 1 for k in range(512)]
    first = sharding.first_map(weights, 8)
    sharding.store(spark, first, path)
    grown = sharding.grow(first, weights)
    assert all(b in (a, 8) for a, b in zip(first.shard_of, grown.shard_of))
    loads, fair = grown.loads(weights), sum(weights) / 9
    assert max(loads) < 1.02 * fair and min(loads) > 0.9 * fair
    assert grown.moved(first) < 512 / 9 * 1.5
    sharding.store(spark, grown, path)
    assert sharding.load(spark, path) == grown and sharding.load(spark, path, 1) == first
    with pytest.raises(Exception):
        sharding.store(spark, grown, path)
    with pytest.raises(ValueError):
        sharding.load(spark, path, 7)
    less = sharding.shrink(grown, weights)
    assert less.version == 3 and max(less.shard_of) == 7
    assert all(a == b for a, b in zip(grown.shard_of, less.shard_of) if a < 8)


def test_rebalance_moves_little():
    weights = [10] * 400
    old = sharding.first_map(weights, 4)
    changed = [w + 2000 * (s == old.shard_of.index(0)) for s, w in enumerate(weights)]
    new = sharding.rebalance(old, changed)
    loads = new.loads(changed)
    assert max(loads) <= max(2010, 1.02 * sum(changed) / 4) and new.moved(old) <= 100
    assert sharding.rebalance(old, weights).moved(old) == 0


def test_second_run_edits_the_stored_map(spark, tmp_path):
    path = str(tmp_path / "map")
    docs = documents(spark)
    before = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, path).collect()}
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(docs, path).collect()} == before
    assert sharding.load(spark, path).version == 1
    more = docs.unionByName(docs.limit(0)).selectExpr("doc_id", "CASE WHEN doc_id < 100 THEN repeat(text, 5) ELSE text END AS text")
    after = {r["doc_id"]: r["shard"] for r in sharding.shard(more, path).collect()}
    assert sharding.load(spark, path).version == 2
    assert 0 < sum(before[k] != after[k] for k in before) < len(before) / 2
