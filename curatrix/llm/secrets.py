"""Secret scan: key-like tokens, and a random forest that removes false positives. DataFrame functions throughout.

Findings are of three kinds: strings in a provider's format, wherever they stand; values of any length and alphabet
that are assigned to a key-like name; and runs of `least` or more characters of the key alphabet. A finding's
features are length, shares of character classes, transitions between classes, how much of its letters words of the
corpus cover, the path it stands in, and the words beside it. The forest learns from labelled findings, either a table
of them or those that `labelled_findings` labels by rule. What the rule looks at is no feature.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.llm.common import LOCATOR, located, save

LEAST = 12  # characters of a run of the key alphabet
SIDE = 48  # code points looked at on either side of a finding for words
WORD_COUNT = 20  # times a word must occur in the corpus to be in the dictionary
FIT_ROWS = 50_000
HINT = "key|token|secret|passw|pwd|auth|credential|bearer|api"
PLACEHOLDER = "example|sample|dummy|test|fake|placeholder|redacted|changeme"
# Provider formats, fixed values.
FORMATS = ("(?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|"
           "eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]++")
# A value after a key-like name and = or :, between quotes or up to white space.
ASSIGNED = f"(?<=[=:\\s\"'])(?<=(?i:{HINT})[\\w-]{{0,24}}[\"']?\\s{{0,4}}[=:]\\s{{0,4}}[\"']?)[^\\s\"'=:][^\\s\"']*+"
NEIGHBOUR_BUCKETS = 16
FEATURES = ["length", "digit_share", "upper_share", "symbol_share", "transitions", "transition_rate", "hex_only",
            "coverage", "path_depth", "path_hint", "path_bucket", "placeholder_near", "before_bucket", "after_bucket"]


def patterns(least: int = LEAST) -> dict[str, str]:
    """Regular expression of each kind of finding, the most specific first."""
    return {"format": FORMATS, "assigned": ASSIGNED, "run": f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{least},}}+"}


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", least: int = LEAST,
             side: int = SIDE) -> DataFrame:
    """One row per finding of located(docs): doc_id, locator, path, kind, token, start, end (code points), left, right.

    Findings of different kinds may overlap; one that several kinds find at the same place is of the first kind.
    """
    text = F.col(text_col)
    head = [F.col(id_col).cast("long").alias("doc_id"), *LOCATOR, F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path")]
    found = None
    for order, (kind, pattern) in enumerate(patterns(least).items()):
        rows = docs.select(*head, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("tokens"), F.split(text, pattern, -1).alias("pieces"))
        rows = rows.where(F.size("tokens") > 0)
        beside = F.transform("tokens", lambda t, i: F.struct(
            t.alias("token"), F.length(F.get("pieces", i)).alias("gap"), F.right(F.get("pieces", i), F.lit(side)).alias("left"),
            F.left(F.get("pieces", i + 1), F.lit(side)).alias("right")))
        each = rows.select("doc_id", *LOCATOR, "path", F.posexplode(beside).alias("place", "f")).select(
            "doc_id", *LOCATOR, "path", "place", "f.*")
        so_far = Window.partitionBy(*LOCATOR).orderBy("place")
        end = F.sum(F.col("gap") + F.length("token")).over(so_far)
        each = each.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("token")).drop("gap", "place")
        each = each.withColumns({"kind": F.lit(kind), "order": F.lit(order)})
        found = each if found is None else found.unionByName(each)
    first = Window.partitionBy(*LOCATOR, "start", "end").orderBy("order")
    return found.withColumn("order", F.row_number().over(first)).where(F.col("order") == 1).drop("order")


def dictionary(docs: DataFrame, wanted: DataFrame, text_col: str = "text", least: int = WORD_COUNT) -> DataFrame:
    """Those words of `wanted` that occur `least` times or more in all of docs, counted over whole texts."""
    words = docs.select(F.explode(F.split(F.lower(text_col), "[^a-z]+")).alias("word")).where("length(word) >= 3")
    counts = words.groupBy("word").count().where(F.col("count") >= least).select("word")
    return counts.join(wanted.select("word").distinct(), "word", "left_semi")


def _bucket(word: Column) -> Column:
    return F.when(word == "", F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(word), F.lit(NEIGHBOUR_BUCKETS - 1)))


def features(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """found with FEATURES as doubles. A token without letters has coverage 0."""
    runs = found.select("token").distinct().withColumn("word", F.explode(F.array_distinct(F.filter(
        F.split(F.lower("token"), "[^a-z]+"), lambda w: F.length(w) >= 3))))
    runs = save(runs, "secret-runs")
    known = dictionary(docs, runs, text_col)
    covered = runs.join(known, "word").groupBy("token").agg(F.sum(F.length("word")).alias("covered"))
    found = found.join(covered, "token", "left")
    token, size = F.col("token"), F.length("token")
    share = lambda pattern: (size - F.length(F.regexp_replace(token, pattern, ""))) / size
    classes = token
    for pattern, code in (("[a-z]", "a"), ("[A-Z]", "B"), ("[0-9]", "0"), ("[+/_-]", "-")):
        classes = F.regexp_replace(classes, pattern, code)
    transitions = F.length(F.regexp_replace(classes, "(.)\\1*+", "x")) - 1
    before = F.lower(F.regexp_extract("left", "([\\p{L}_]+)[^\\p{L}_]*$", 1))
    after = F.lower(F.regexp_extract("right", "^[^\\p{L}_]*([\\p{L}_]+)", 1))
    letters = size - F.length(F.regexp_replace(token, "[A-Za-z]", ""))
    near = F.lower(F.concat_ws(" ", "left", "token", "right"))
    columns = {
        "length": size, "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"), "symbol_share": share("[+/_-]"),
        "transitions": transitions, "transition_rate": transitions / size, "hex_only": token.rlike("^[0-9a-f]+$"),
        "coverage": F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0)) / F.greatest(letters, F.lit(1))),
        "path_depth": F.size(F.split("path", "/")), "path_hint": F.lower("path").rlike(f"{PLACEHOLDER}|docs?/|spec"),
        "path_bucket": _bucket(F.lower("path")), "placeholder_near": near.rlike(PLACEHOLDER),
        "before_bucket": _bucket(before), "after_bucket": _bucket(after),
    }
    return found.withColumns({name: value.cast("double") for name, value in columns.items()}).drop("covered")


def labelled_findings(found: DataFrame) -> DataFrame:
    """found with label: 1 for a provider's format, or a value of letters and digits, 16 or more, assigned to a key-like name."""
    mixed = (F.col("digit_share") > 0) & (F.col("digit_share") < 1) & (F.length("token") >= 16)
    return found.withColumn("label", ((F.col("kind") == "format") | ((F.col("kind") == "assigned") & mixed)).cast("double"))


def fit(labelled: DataFrame, trees: int = 20, depth: int = 6, fit_rows: int = FIT_ROWS, seed: int = 7):
    """Random forest on at most `fit_rows` labelled findings, chosen by hash. None unless both labels occur."""
    chosen = labelled.orderBy(F.xxhash64("doc_id", "start", "token"), "doc_id", "start", "token").limit(fit_rows)
    chosen = save(chosen.select("label", *FEATURES), "secret-fit")
    counts = chosen.groupBy("label").count().collect()
    if len(counts) < 2:
        return None
    total = sum(r["count"] for r in counts)
    weight = F.coalesce(*[F.when(F.col("label") == r["label"], total / (2.0 * r["count"])) for r in counts])
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees,
                                    maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(chosen.withColumn("weight", weight))


def scan(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
         reviewed: DataFrame | None = None, labels: DataFrame | None = None, threshold: float = 0.5, least: int = LEAST,
         side: int = SIDE) -> DataFrame:
    """Findings with label, score and secret (score at or above threshold); `learn` picks the rows to learn from.

    labels: findings judged by people (doc_id, start, end, label 0 or 1); findings that are not in it have no label and
    teach nothing. None: labels by rule. reviewed: ids of the documents from whose findings alone the forest learns;
    None: all that `learn` picks. Null texts have no findings, null paths are ''. Where the findings to learn from do
    not have both labels there is no model, and nothing is judged: score and secret are null.
    `least` and `side` bound what a run and its neighbourhood are; a word further off than `side` is not seen.
    """
    docs = located(docs)
    found = save(findings(docs, id_col, text_col, path_col, least, side), "secret-findings")
    found = features(found, docs, text_col)
    if labels is None:
        found = labelled_findings(found)
    else:
        judged = labels.select(F.col("doc_id").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"),
                               F.col("label").cast("double")).groupBy("doc_id", "start", "end").agg(F.max("label").alias("label"))
        found = found.join(judged, ["doc_id", "start", "end"], "left")
    found = save(found, "secret-features")
    known = found.where(learn & F.col("label").isNotNull())
    if reviewed is not None:
        known = known.join(reviewed.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    model = fit(known)
    if model is None:
        return found.withColumn("score", F.lit(None).cast("double")).withColumn("secret", F.lit(None).cast("boolean"))
    scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction").withColumn("secret", F.col("score") >= threshold)
