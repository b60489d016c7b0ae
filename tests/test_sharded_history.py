"""What a step of the sharded regressions keeps grows with rows and models, not with terms; pieces do not shrink with models."""

from pyspark.sql import functions as F

from curatrix.operators import sharded

MODELS, ROWS, TERMS = 5, 40, 5000


def test_state_has_numbers_of_rows_only(spark, monkeypatch):
    rows = [(i, i % 2, [i % 7, *range(100 + 20 * i, 120 + 20 * i)], [1 + i % 3] * 21) for i in range(ROWS)]
    df = spark.createDataFrame(rows, "id long, label int, ix array<int>, tf array<long>").coalesce(1)
    written = []

    def kept(table, name, plain=sharded.saved):
        made = plain(table, name)
        written.extend([made] if name == "state" else [])
        return made

    monkeypatch.setattr(sharded, "saved", kept)
    pieces = []
    for models in (1, MODELS):
        many = sharded.ManyLogistic(df, "label", [F.col("id") != m for m in range(models)], TERMS, ["id"], 1, entries=420)
        pieces.append(many.shards.n_pieces)
        if models > 1:
            assert many.fit(max_steps=2).steps == 2
        many.release()
    assert pieces == [2, 2]
    vectors = 2 * (2 * sharded.HISTORY + 4)
    held = written[-1].filter(F.col("shard") == sharded.STATE).agg(F.sum(F.octet_length("values"))).first()[0]
    assert held == 8 * vectors * MODELS * ROWS
