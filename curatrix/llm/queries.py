"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import (alignment, chat, decontamination, exact_dedup, mixing, negatives, pii, quality, secrets, sharding, simhash,
                          url_filter, warc)
from curatrix.llm.common import A_TO_Z, save, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_warc_transactions", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS stored FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN stored IS NULL OR stored = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN stored <> page_id THEN stored END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000""")
def warc_transactions(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), path)
    rows = warc.assemble(warc.read_archives(spark, path, with_payload=False))
    field = lambda name: F.col("metadata.fields")[name].cast("long")
    return rows.select(field("pageid").alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"),
                       F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.type").alias("record_type"),
                       field("referstopage").alias("refers_to"))


@query("op2_simhash_components")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.cluster(table(spark, folder, "documents"))
    return rows.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id", "n_rows")


@query("op3_contextual_pii")
def contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    rows = pii.extract(table(spark, folder, "documents"))
    return rows.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_found")


@query("op4_forest_secrets")
def forest_secrets(spark: SparkSession, folder: str) -> DataFrame:
    rows = secrets.scan(table(spark, folder, "documents"), ~quality.held_out(), reviewed=table(spark, folder, "labels"))
    return rows.select("doc_id", "start", "end", "kind", F.sha2("token", 256).alias("token_sha256"), "score", "secret",
                       "label", quality.held_out().alias("held_out"))


@query("op5_compression_quality")
def compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels").where(~quality.held_out()))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _url_sql() -> str:
    lower = f"translate({{}}, '{A_TO_Z}', '{A_TO_Z.lower()}')"
    terms = ", ".join(f"('{t}', {w})" for t, w in url_filter.VOCABULARY.items())
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)
    return f"""
WITH terms(term, weight) AS (VALUES {terms}), rules(rh, rp, rv) AS (VALUES {rules}),
u AS (SELECT row_number() OVER () AS k, page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT k, page_id, {lower.format('url')} AS low,
      CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM u),
h AS (SELECT k, page_id, low, {lower.format("regexp_extract(rest, '^[^/]*')")} AS host,
      CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM s),
r AS (SELECT k, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k),
v AS (SELECT k, count(*) FILTER (weight >= 1) AS strict, count(*) FILTER (weight < 1) AS soft
      FROM h JOIN terms ON regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY k)
SELECT page_id, host, path, rule,
       coalesce(rv, CASE WHEN coalesce(strict, 0) > 0 OR coalesce(soft, 0) >= {url_filter.SOFT_NEEDED} THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN r USING (k) LEFT JOIN v USING (k)"""


@query("op6_url_vocabulary", _url_sql())
def url_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _escaped_sql(column: str) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


#: A conversation whose texts are made of control strings.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op7_prefix_targets", f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES {', '.join(str(row) for row in ADDED)})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + {len(chat.OPEN + chat.BETWEEN + chat.CLOSE)})::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM c GROUP BY conv_id""")
def prefix_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    turns = save(chat.format_turns(rows.unionByName(added)), "chat-turns")
    return chat.read_back(save(chat.expand(turns), "chat-examples"))


@query("op8_stream_dedup", """
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS b
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY b) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(b) AS text_sha256
FROM n WINDOW w AS (PARTITION BY b ORDER BY length(t) DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup.decisions(table(spark, folder, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op9_soft_mixing")
def soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Languages as domains; only labelled documents show theirs to the classifier."""
    docs = table(spark, folder, "documents")
    labelled = table(spark, folder, "labels").select("doc_id").distinct().join(docs.select("doc_id", "lang"), "doc_id")
    rows = mixing.mix(docs.select("doc_id", "text"), labelled.select("doc_id", F.col("lang").alias("domain")),
                      {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2})
    return rows.select("doc_id", "tokens", "posterior", "domains", "rate", "copies")


@query("op10_positional_index", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
        FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""")
def positional_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontamination.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_words", decontamination.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       decontamination.items_digest().alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query("op11_threshold_negatives", """
WITH p AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
      FROM p a JOIN p r ON a.id <> r.id WHERE a.id % 50 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (SELECT anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INT AS rank
        FROM pos JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3""")
def threshold_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.participants(rows.withColumn("label", label)), F.col("id") % 50 == 0)


@query("op12_interval_alignment")
def interval_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"))


@query("op13_virtual_slots", f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
      xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT % {sharding.SLOTS} AS virtual_slot
      FROM documents, crc),
w AS (SELECT virtual_slot, sum(size)::BIGINT AS w FROM d GROUP BY virtual_slot),
r AS (SELECT virtual_slot, w, row_number() OVER (ORDER BY w DESC, virtual_slot) AS k FROM w),
m(k, virtual_slot, shard, loads) AS (
    SELECT 0::BIGINT, -1::BIGINT, -1::BIGINT, list_transform(range(8), lambda x: 0::BIGINT)
    UNION ALL
    SELECT r.k, r.virtual_slot, list_position(loads, list_min(loads)) - 1,
           list_transform(loads, lambda x, i: x + CASE WHEN i = list_position(loads, list_min(loads)) THEN r.w ELSE 0 END)
    FROM m JOIN r ON r.k = m.k + 1)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       NULL::INT AS grown_shard, virtual_slot::INT AS virtual_slot
FROM d JOIN m USING (virtual_slot)""")
def virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.shard(table(spark, folder, "documents"), scratch(spark, "slot-map"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
