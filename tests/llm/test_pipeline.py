"""The pipeline's stages one by one against brute force on their own inputs."""

import re

import pytest

import corpus_pipeline
from curatrix.llm import quality
from curatrix.llm.common import save
from tests.llm.test_decontamination import brute_words
from tests.llm.test_simhash import brute_fingerprint, classes, close

FOLDER = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(save(stage(spark, frames[-1], FOLDER), f"test-{name}"))
    return frames


def rows(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns(run):
    for frame in run[:-1]:
        assert frame.columns == run[0].columns
    assert run[-1].columns == [*run[0].columns, "tokens", "rate", "copies"]


def test_quality(spark, run):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(run[0], labels.where(~quality.held_out()))
    made = model.compressors() if model.dictionaries[0] else None
    before, after = rows(run[0]), rows(run[1])
    assert set(after) == {i for i, t in before.items() if (model.score((t or "").encode(), made) if made else model.prior) >= 0.3}
    assert 0 < len(after) < len(before)


def test_exact(run):
    before, after = rows(run[1]), rows(run[2])
    groups = {}
    for i, t in before.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    assert set(after) == {min(g)[1] for g in groups.values()}


def test_near(run):
    before, after = rows(run[2]), rows(run[3])
    fp = {i: brute_fingerprint(t) for i, t in before.items()}
    root = classes(close(sorted(set(fp.values()))), set(fp.values()))
    first = {}
    for i in sorted(before):
        first.setdefault(root[fp[i]], i)
    assert set(after) == set(first.values())


def test_benchmark(spark, run):
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = brute_words(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    before, after = rows(run[3]), rows(run[4])

    def dirty(text):
        w = brute_words(text)
        return any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert set(after) == {i for i, t in before.items() if not dirty(t)}
    assert len(after) < len(before)


def test_mixing_keeps_every_document(run):
    assert set(rows(run[5])) == set(rows(run[4]))
    assert run[5].where("rate < 1 or copies < 1").count() == 0


def test_run_and_odd_tables(spark, run):
    assert corpus_pipeline.run(spark, FOLDER).count() == run[-1].count()
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "tie tie", "en", "s", 7), (2, "tie other", "en", "s", 9),
           (3, "long " * 60_000, "de", "s", 1)]
    schema = run[0].schema.simpleString()[7:-1]
    for data in (odd, []):
        frame = spark.createDataFrame(data, run[0].schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, FOLDER)
            assert out.columns == frame.columns and out.count() <= frame.count(), (name, schema)
        assert STAGES["mixing"](spark, frame, FOLDER).count() == len(data)
