"""Scans, sinks and curation jobs."""

import gzip

from pyspark.sql import functions as F

from curatrix.constants import RAW_RENAMES
from curatrix.plans import curation
from curatrix.plans.registry import contract_check
from curatrix.sources import sinks
from curatrix.sources import tables as S


def test_paired_scan_finds_the_header(spark, tmp_path):
    for name, text in {
        "a.csv.gz": '{"meta": 1}\nid,Sequence_Alignment_AA_Heavy ,light_sequence\n1,QVQ,DIV\n2,too,many,cells\n3,EVQ,\n4,CVQ\n',
        "b.csv.gz": "heavy_sequence,light_sequence\nAAA,BBB\n",
        "c.csv.gz": "nothing,useful\n1,2\n",
    }.items():
        with gzip.open(tmp_path / name, "wt") as out:
            out.write(text)
    rows = S.scan_paired_files(spark, [str(tmp_path)]).collect()
    assert sorted((r["source_file"], r["heavy_raw"], r["light_raw"]) for r in rows) == [
        ("a.csv.gz", "CVQ", ""), ("a.csv.gz", "EVQ", ""), ("a.csv.gz", "QVQ", "DIV"), ("b.csv.gz", "AAA", "BBB")]


def test_text_scan_keeps_blanks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,\nNA,x\n")
    assert [tuple(r) for r in S.read_csv_text(spark, str(path)).collect()] == [("1", ""), ("NA", "x")]
    typed = S.read_csv_typed(spark, str(path), spark.createDataFrame([], "a string, b string").schema)
    assert [tuple(r) for r in typed.collect()] == [("1", None), (None, "x")]
    assert S.pick_source(["z.csv", "x/records_main.csv", "a.txt"], ("records",)) == "x/records_main.csv"
    try:
        S.require_columns(typed, ["a", "q"])
        raise AssertionError("a missing column passed")
    except KeyError:
        pass


def test_embeddings_must_match(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, embedding array<float>")
    try:
        S.load_embeddings(vectors, rows, "id")
        raise AssertionError("odd lengths passed")
    except ValueError:
        pass


def raw(spark):
    names = [*RAW_RENAMES, "Binds to", "Neutralising Vs", "Not Neutralising Vs"]
    base = {n: "" for n in names}
    rows = [
        {**base, "VHorVHH": "qvq", "VL": "ND", "Binds to": "SARS-CoV2", "Neutralising Vs": "SARS_CoV-2"},
        {**base, "VHorVHH": "QVQ", "VL": "-", "Binds to": "sars cov 2", "Not Neutralising Vs": "sarscov2"},
        {**base, "VHorVHH": "EVQ", "VL": "D1V", "Binds to": "SARS-CoV-2", "Not Neutralising Vs": "SARS-CoV2"},
        {**base, "VHorVHH": "ND", "VL": "DIV", "Binds to": "SARS-CoV2"},
        {**base, "VHorVHH": "AAA", "Binds to": "MERS"},
        {**base, "VHorVHH": "CCC", "Binds to": "SARS-CoV2", "Neutralising Vs": "SARS-CoV2", "Not Neutralising Vs": "SARS-CoV2"},
    ]
    df = spark.createDataFrame([(i, *[r[n] for n in names]) for i, r in enumerate(rows)],
                               "i int, " + ", ".join(f"`{n}` string" for n in names))
    return df.repartition(4)


def test_curation_funnel(spark):
    final, metrics = curation.curate(raw(spark), "i")
    kept = {r["sequence_key"]: (r["i"], r["duplicate_count"], r["neutralising_label"]) for r in final.collect()}
    assert kept == {"QVQ": (0, 2, 1), "EVQ__D1V": (2, 1, 0), "CCC": (5, 1, 1)}
    counts = {r["metric"]: r["count"] for r in metrics.collect()}
    assert counts["raw_rows"] == 6 and counts["filtered_rows"] == 5 and counts["invalid_light"] == 1
    assert counts["removed_without_key"] == 1 and counts["removed_copies"] == 1 and counts["conflicts"] == 1
    table, steps = curation.strict_table(final)
    assert {r["step"]: r["rows"] for r in steps.collect()} == {"kept": 1, "conflict": 1, "invalid_light": 1}
    assert table.first()["sequence_pair_text"] == "QVQ" and table.first()["light_length"] is None


def test_contract_check(spark, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    sinks.write_csv(spark.range(2), good)
    sinks.write_csv(spark.range(2).select(F.lit("x").alias("VL")), bad)
    passed = {r["path"]: r["passed"] for r in contract_check(spark, [good, bad, str(tmp_path / "none")]).collect()}
    assert list(passed.values()) == [True, False, False]


def test_files_of_one_name_in_two_folders_keep_their_own_preamble(spark, tmp_path):
    for folder, text in {"x": "note\nheavy_sequence,light_sequence\nA,B\n", "y": "light_sequence,heavy_sequence\nnote\nB,A\nheavy_sequence,light_sequence\n"}.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.csv").write_text(text)
    rows = S.scan_paired_files(spark, [str(tmp_path)]).collect()
    assert sorted((r["source_file"], r["heavy_raw"], r["light_raw"]) for r in rows) == [
        ("same.csv", "", "note"), ("same.csv", "A", "B"), ("same.csv", "A", "B"), ("same.csv", "light_sequence", "heavy_sequence")]


def test_no_header_gives_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert S.scan_paired_files(spark, [str(tmp_path)]).count() == 0


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('a,b\n"one\ntwo",x\n')
    assert [tuple(r) for r in S.read_csv_text(spark, str(path), multi_line=True).collect()] == [("one\ntwo", "x")]


def test_matrix_rows_belong_to_table_rows_by_place(spark, tmp_path):
    path = str(tmp_path / "matrix")
    spark.createDataFrame([([float(i), 1.0],) for i in range(9)], "embedding array<double>").coalesce(1).write.parquet(path)
    rows = spark.createDataFrame([(f"r{i}", i) for i in range(9)], "name string, place long").repartition(4)
    got = {r["name"]: r["embedding"][0] for r in S.load_matrix(spark, path, rows, ["place"]).collect()}
    assert got == {f"r{i}": float(i) for i in range(9)}
    for wrong in (rows.limit(8), rows.union(rows.limit(1))):
        try:
            S.load_matrix(spark, path, wrong, ["place"])
            raise AssertionError("another number of rows passed")
        except ValueError:
            pass
