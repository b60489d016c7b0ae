"""Searches of the catalog ask with every row, against all references."""

import numpy as np
import pytest

from curatrix.catalog import QUERIES


@pytest.mark.parametrize("name", ["n1_nearest_embeddings", "n1_nearest_in_blocks"])
def test_all_rows_meet_all_references(spark, tmp_path, name):
    x = np.random.default_rng(5).normal(size=(260, 6))
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(None, 1, [1.0] * 6)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = np.array(x, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    refs = [i for i in range(260) if i % 3 == 0]
    got = {r["vec_id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == {*range(260), None}
    unit = np.vstack([unit, np.full(6, 6 ** -0.5)])
    for i in got:
        sims = unit[refs] @ unit[260 if i is None else i]
        assert got[i]["nearest_id"] == refs[int(np.argmax(sims))] and abs(got[i]["max_similarity"] - sims.max()) < 1e-5
