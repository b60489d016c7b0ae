"""Quirks of cleaning, parsing and rules on small literal frames."""

from pyspark.sql import functions as F

from curatrix.functions import text as X
from curatrix.functions import values as V
from curatrix.functions.spans import mark_spans
from curatrix.operators import rules as R
from curatrix.operators.columns import detect_roles, public_projection, rename_by_alias, rename_by_position
from curatrix.operators.profile import aggregate_runs, metric_correlations


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_missing_markers(spark):
    values = ["nd", " N/D ", "n/a", "-", "not determined", "", None, "QVQ"]
    assert column(spark, values, X.is_missing) == [True, True, False, True, True, True, True, False]
    assert column(spark, values, X.is_missing_text) == [True, False, True, False, False, True, True, False]


def test_clean_sequence_modes(spark):
    values = ["qv q*X", " nd ", " ab c"]
    assert column(spark, values, lambda v: X.clean_sequence(v, "placeholder")) == ["QVQ*X", None, "ABC"]
    assert column(spark, values, lambda v: X.clean_sequence(v, "token")) == ["QVQ*X", "", "ABC"]
    assert column(spark, values, lambda v: X.clean_sequence(v, "canonical")) == ["QVQ", "ND", "AC"]
    assert column(spark, values, lambda v: X.clean_sequence(v, "compact")) == ["QVQ*X", "ND", "ABC"]


def test_motifs_overlap(spark):
    assert column(spark, ["NNSTNAT", "NPS", ""], V.motif_count) == [3, 0, 0]
    assert column(spark, ["NNSTNAT", "NPS", ""], lambda v: V.motif_count(v, False)) == [2, 0, 0]


def test_numbers_and_labels(spark):
    values = ["1.0", "1d", " 0 ", "Positive", "NON-neutralising", "?", None, "2"]
    assert column(spark, values, V.to_number) == [1.0, None, 0.0, None, None, None, None, 2.0]
    assert column(spark, values, V.parse_label) == [1.0, None, 0.0, 1.0, 0.0, None, None, 2.0]
    assert column(spark, values, V.binary_label) == [1, None, 0, None, None, None, None, None]


def test_region_and_tokens(spark):
    values = ["S; RBD", "N-terminal domain", " s ", "Spike", "n/a", "helix", None]
    assert column(spark, values, V.region_group) == ["RBD", "NTD", "Spike/S", "Spike/S", "unknown", "other", "unknown"]
    assert column(spark, [" ; b|c", "", None, ";;"], X.primary_token) == ["b", "missing_source", "missing_source", ";;"]


def test_pair_split(spark):
    first = column(spark, ["H[SEP]L[SEP]x", "H"], lambda v: X.split_pair(v)[0])
    second = column(spark, ["H[SEP]L[SEP]x", "H"], lambda v: X.split_pair(v)[1])
    assert (first, second) == (["H", "H"], ["L[SEP]x", ""])


def test_mark_spans(spark):
    df = spark.createDataFrame([("ABCDABEF", "AB", "AB", "ZZ")], "s string, a string, b string, c string")
    m = df.select(mark_spans(F.col("s"), [("cdrh1", F.col("a")), ("cdrh2", F.col("b")), ("cdrh3", F.col("c"))]).alias("m")).first()["m"]
    assert m["marked_text"] == "<CDRH1_START> A B <CDRH1_END> C D <CDRH2_START> A B <CDRH2_END> E F"
    assert (m["failed_regions"], m["ambiguous_regions"], m["ok"]) == ("cdrh3", "cdrh1", False)


def test_rule_precedence(spark):
    rows = [(1, True, 0.9, "high", "low"), (1, False, 0.9, "high", "high"), (None, False, 0.9, "high", "medium"), (0, False, 0.5, "low", "low")]
    df = spark.createDataFrame(rows, "label int, conflict boolean, score double, confidence_bin string, risk_bin string")
    out = df.withColumn("record_category", R.record_category()).withColumn("p", R.priority_category()).collect()
    assert [r["record_category"] for r in out] == ["conflict_label", "known_neutralising", "missing_label", "known_non_neutralising"]
    assert [r["p"] for r in out] == ["high_score_conflict_label", "high_score_but_sequence_risk", "high_score_missing_label", "uncertain_prediction"]


def test_names(spark):
    df = spark.createDataFrame([(" ", "b", "c")], "x string, y string, z string")
    renamed, absent = rename_by_position(df, {0: "a", 7: "q"})
    assert renamed.columns == ["a", "extra_col_01", "extra_col_02"] and absent == [7]
    assert rename_by_alias(df, {"x": "t", "y": "t"}).first().asDict() == {"t": "b", "extra_col_02": "c"}
    try:
        public_projection(df.withColumnRenamed("x", "VL"), ["VL", "y"])
        raise AssertionError("a forbidden column passed")
    except ValueError:
        pass
    roles = detect_roles(spark, ["VH or VHH", "CDR H3", "Light sequence"], {"heavy": ["vh or vhh"], "light": ["light sequence"]})
    assert {(r["role"], r["column"], r["score"]) for r in roles.collect()} >= {("heavy", "VH or VHH", 1.0), ("light", "Light sequence", 1.0)}


def test_correlation_and_runs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "m double, s double, c double")
    got = {r["signal"]: r["correlation"] for r in metric_correlations(df, ["m"], ["s", "c"]).collect()}
    assert got["c"] is None and got["s"] > 0.99
    runs = aggregate_runs(spark.createDataFrame([("a", 0.7)], "g string, v double"), ["g"], "v", 0.6).first()
    assert runs["std"] == 0.0 and runs["all_beat_baseline"] and runs["stable"]
