"""What n-gram steps write and shuffle: large slices, entries that keep their terms, written blocks in row groups."""

import glob
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from curatrix.lineage import saved
from curatrix.operators import models as MO
from curatrix.operators import ngrams as N


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_slices_are_larger_than_the_pieces_that_are_counted(spark):
    rows = [(i, "ab cd " * 40_000) for i in range(16)]
    packed = N.pack(spark.createDataFrame(rows, "id long, text string").repartition(8), "text", ["id"]).cache()
    assert packed.count() <= 8  # one for each task; 16 where a slice was a piece
    assert packed.select(F.explode("rows.id").alias("id")).orderBy("id").collect() == [(i,) for i in range(16)]
    assert packed.schema["rows"].dataType.elementType.names == ["id"]


def test_entries_get_their_terms_without_another_join(spark):
    docs = spark.createDataFrame([(1, "abcabc"), (2, "abc  x"), (2, "abc  x"), (None, "abcd"), (3, None)], "id long, text string")
    long = N.tfidf(docs, "id", "text", N.text_vocab(docs, "text"), 5)
    assert plan(long).count("Join") == 2  # terms of slices with the vocabulary, slices with what is known
    vectors, terms = N.fit_tfidf_rows(docs, "id", "text")
    names = {r["ix"]: r["term"] for r in terms.collect()}
    want = sorted((str(r["id"]), names[i], round(w, 12)) for r in vectors.collect() for i, w in zip(r["ix"], r["w"]))
    assert sorted((str(r["id"]), r["term"], round(r["weight"], 12)) for r in long.collect()) == want


def test_vectors_that_are_read_again_are_the_same(spark):
    docs = spark.createDataFrame([(i, f"abcd {i % 3} efgh") for i in range(9)], "id long, text string")
    one, two = ({r["id"]: (r["ix"], r["w"]) for r in N.fit_tfidf_rows(docs, "id", "text", again=a)[0].collect()} for a in (False, True))
    assert one == two and len(one) == 9


def test_summary_of_ngrams(spark):
    docs = spark.createDataFrame([(1, "ünabcabc"), (1, "abz"), (None, "zzzz"), (2, ""), (3, None)], "id long, text string")
    grams = N.char_ngrams(docs, "id", "text")
    want = grams.groupBy("id").agg(F.count("*"), F.sum("tf"), F.max("tf").cast("long"), F.min("term")).collect()
    assert sorted(map(str, map(tuple, N.summarise_ngrams(grams, "id").collect()))) == sorted(map(str, map(tuple, want)))


def test_wide_rows_are_written_in_several_row_groups(spark):
    def fill(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                x = pa.array([np.random.default_rng(i).bytes(1 << 20)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([i]), x], names=["id", "x"])

    blocks = spark.range(0, 60, 1, 1).mapInArrow(fill, "id long, x binary")
    path = saved(blocks, "wide").inputFiles()[0].removeprefix("file://")
    assert pq.ParquetFile(glob.glob(path)[0]).num_row_groups > 1


def test_tasks_of_a_pass_do_not_grow_with_rows():
    assert [MO.pass_tasks(rows, 1 << 20, 12) for rows in (10, 5_000, 3_000_000)] == [1, 5, 12]
    assert MO.pass_tasks(3_000_000, 30 << 30, 12) == 120


def test_counts_of_a_table_equal_plain_counts():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdeü "), 400)) for _ in range(7)]
    names = sorted({t[i:i + n] for t in texts for n in (3, 4, 5) for i in range(0, len(t) - n, 3)})
    rows, ix, counts = N.TermTable(names).count(texts, 3, 5)
    place = {t: i for i, t in enumerate(names)}
    want = {}
    for r, t in enumerate(texts):
        for n in (3, 4, 5):
            for i in range(len(t) - n + 1):
                if t[i:i + n] in place:
                    want[r, place[t[i:i + n]]] = want.get((r, place[t[i:i + n]]), 0) + 1
    assert list(zip(rows.tolist(), ix.tolist(), counts.tolist())) == [(*k, v) for k, v in sorted(want.items())]


def test_lines_held_do_not_grow_with_the_variety_of_the_text():
    """Texts of ever new terms: tables of bounded length, which add up to the whole count."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=30)) for _ in range(2600)]
    tables = list(N._slice_terms(pa.array(texts), 3, 5, 5_000))
    windows = [[t[i:i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)] for t in texts]
    assert len(tables) > 2 and max(t.num_rows for t in tables) < 5_000 + 500 * 81
    df, total = Counter(), Counter()
    for table in tables:
        for line in table.to_pylist():
            df[line["term"]] += line["df"]
            total[line["term"]] += line["total"]
    assert total == Counter(w for ws in windows for w in ws)
    assert df == Counter(w for ws in windows for w in set(ws))
    assert len(list(N._slice_terms(pa.array(texts), 3, 5))) == 1
