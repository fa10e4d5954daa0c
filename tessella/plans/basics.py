"""Scans, filters, sorts, aggregates: queries over the record store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import time as TM
from ..functions.vector import dot
from ..operators import aggregates, filters
from ..sources import exchange
from ..sources.records import NOW, now, records, table
from .registry import query

LIVE = "status = 'active' AND superseded_by IS NULL"
CLOCK = datetime.fromisoformat(NOW)


@query("scan_profiles", "SELECT DISTINCT profile FROM mem")
def scan_profiles(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("profile").distinct()


@query("fallback_rowscan", f"""
WITH r AS (SELECT uuid, profile, trust_score, row_number() OVER (PARTITION BY profile ORDER BY trust_score DESC, uuid) AS rn FROM mem WHERE {LIVE}),
s AS (SELECT *, count(*) OVER (PARTITION BY profile) AS n FROM r WHERE rn <= 30)
SELECT uuid, profile, trust_score, round(0.1::DOUBLE + 0.4::DOUBLE * (rn - 1) / greatest(n - 1, 1), 6) AS distance FROM s""")
def fallback_rowscan(spark: SparkSession, d: str) -> DataFrame:
    return filters.by_trust(records(spark, d), 30)


@query("export_json", """SELECT uuid, to_json({'uuid': uuid, 'data_type': data_type, 'data_id': data_id, 'priority': priority, 'status': status, 'trust_score': trust_score}) AS line
FROM mem WHERE status = 'active' AND profile = 'alpha'""")
def export_json(spark: SparkSession, d: str) -> DataFrame:
    return exchange.json_lines(filters.status(records(spark, d), "active", heads_only=False).where("profile = 'alpha'"))


@query("export_md", """SELECT uuid, concat('## ', topic, chr(10), chr(10), content, chr(10), chr(10), '- type: ', data_type, '/', data_id, chr(10), '- trust: ', CAST(trust_score AS VARCHAR)) AS block
FROM mem WHERE status = 'active' AND profile = 'beta'""")
def export_md(spark: SparkSession, d: str) -> DataFrame:
    return exchange.markdown(filters.status(records(spark, d), "active", heads_only=False).where("profile = 'beta'"))


@query("traces_recent", """SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND instr(lower(event_type), 'ick') > 0
ORDER BY ts DESC, event_id DESC LIMIT 200""", mem=False)
def traces_recent(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")
    return filters.recent_traces(events, "ick", 200)


@query("session_first_compaction", "SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS head FROM conversations WHERE role = 'system' GROUP BY conv_id", mem=False)
def session_first_compaction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'system'")
    return rows.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by("text", "turn").alias("head"))


for _status, _where in (("active", LIVE), ("deleted", "status = 'deleted'"), ("all", "true")):

    @query(f"filter_status_{_status}", f"SELECT uuid, status FROM mem WHERE {_where}")
    def _by_status(spark: SparkSession, d: str, s: str = _status) -> DataFrame:
        return filters.status(records(spark, d), s).select("uuid", "status")


@query("filter_ttl", "SELECT uuid, ttl FROM mem WHERE ttl IS NULL OR ttl > TIMESTAMP '2026-01-01 00:00:00'")
def filter_ttl(spark: SparkSession, d: str) -> DataFrame:
    return filters.unexpired(records(spark, d), now()).select("uuid", "ttl")


@query("filter_temporal", "SELECT uuid, created_at FROM mem WHERE created_at >= TIMESTAMP '2025-09-01 00:00:00' AND created_at <= TIMESTAMP '2025-11-30 23:59:59'")
def filter_temporal(spark: SparkSession, d: str) -> DataFrame:
    return filters.temporal(records(spark, d), "what did we decide last fall", CLOCK).select("uuid", "created_at")


@query("filter_equality", "SELECT uuid FROM mem WHERE data_type = 'CODE' AND data_id = 'src3'")
def filter_equality(spark: SparkSession, d: str) -> DataFrame:
    return filters.equal(records(spark, d), data_type="CODE", data_id="SRC3").select("uuid")


@query("delete_many_dryrun", f"""
WITH hit AS (SELECT * FROM mem WHERE status = 'active' AND content ILIKE '%the%' AND data_type = 'CUSTOM')
SELECT count(*) FILTER (NOT protected) AS would_delete, count(*) FILTER (protected) AS skipped, count(*) FILTER (NOT protected) > 100 AS refused,
 (SELECT string_agg(uuid, ',' ORDER BY uuid) FROM (SELECT uuid FROM hit WHERE NOT protected ORDER BY uuid LIMIT 5)) AS sample FROM hit""")
def delete_many_dryrun(spark: SparkSession, d: str) -> DataFrame:
    return filters.delete_dry_run(records(spark, d), content_like="%the%", data_type="CUSTOM")


@query("missing_metadata", "SELECT uuid, len(keywords) = 0 AS no_keywords, embedding IS NULL AS no_vector FROM mem WHERE len(keywords) = 0 OR embedding IS NULL OR topic = ''")
def missing_metadata(spark: SparkSession, d: str) -> DataFrame:
    return filters.missing(records(spark, d)).select("uuid", (F.size("keywords") == 0).alias("no_keywords"), F.col("embedding").isNull().alias("no_vector"))


_LOW = "[" + ", ".join(f"'{w}'" for w in T.LOW_CONTENT) + "]"


@query("gate_low_content", rf"""SELECT conv_id, turn, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) > 1 AND NOT list_contains({_LOW}, t))) = 0 AS low
FROM conversations""", mem=False)
def gate_low_content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.low_content(F.col("text")).alias("low"))


@query("review_batch", f"""SELECT uuid, created_at FROM mem WHERE {LIVE} AND epoch(TIMESTAMP '2026-01-01 00:00:00' - created_at) / 3600.0 >= 24 ORDER BY created_at, uuid LIMIT 200""")
def review_batch(spark: SparkSession, d: str) -> DataFrame:
    old = filters.status(records(spark, d), "active").where(TM.age_seconds(F.col("created_at"), now()) / 3600.0 >= 24)
    return old.orderBy("created_at", "uuid").limit(200).select("uuid", "created_at")


@query("orphans_vector", f"SELECT e.vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM mem WHERE uuid = e.vec_id AND {LIVE})")
def orphans_vector(spark: SparkSession, d: str) -> DataFrame:
    live = filters.status(records(spark, d), "active").select(F.col("uuid").alias("vec_id"))
    return table(spark, d, "embeddings").select("vec_id").join(live, "vec_id", "left_anti")


@query("misfiled_vector", "SELECT m.uuid, e.label FROM embeddings e JOIN mem m ON m.uuid = e.vec_id WHERE e.label % 7 <> m.uuid % 7")
def misfiled_vector(spark: SparkSession, d: str) -> DataFrame:
    # the collection of a vector is its label; the record's type says where it belongs
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("uuid"), "label")
    return e.join(records(spark, d).select("uuid"), "uuid").where("label % 7 <> uuid % 7")


@query("count_active", f"SELECT count(*) AS n FROM mem WHERE {LIVE}")
def count_active(spark: SparkSession, d: str) -> DataFrame:
    return filters.status(records(spark, d), "active").agg(F.count("*").alias("n"))


@query("seed_overview", f"""SELECT data_type, data_id, count(*) AS n, round(avg(trust_score), 2) AS trust, string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM mem WHERE {LIVE} GROUP BY ALL ORDER BY n DESC, data_type, data_id LIMIT 15""")
def seed_overview(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.overview(filters.status(records(spark, d), "active"), 15)


@query("top_trusted", f"SELECT uuid, trust_score FROM mem WHERE {LIVE} ORDER BY trust_score DESC, updated_at DESC, uuid LIMIT 1")
def top_trusted(spark: SparkSession, d: str) -> DataFrame:
    return filters.status(records(spark, d), "active").orderBy(F.desc("trust_score"), F.desc("updated_at"), "uuid").limit(1).select("uuid", "trust_score")


@query("review_histogram", f"SELECT coalesce(CASE uuid % 6 WHEN 0 THEN 'keep' WHEN 1 THEN 'delete' WHEN 2 THEN 'pending' END, 'unreviewed') AS review, count(*) AS n FROM mem WHERE {LIVE} GROUP BY 1")
def review_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.status(records(spark, d), "active").withColumn("llm_review_status", F.expr("case uuid % 6 when 0 then 'keep' when 1 then 'delete' when 2 then 'pending' end"))
    return rows.groupBy(F.coalesce("llm_review_status", F.lit("unreviewed")).alias("review")).agg(F.count("*").alias("n"))


@query("count_by_type", f"SELECT data_type, count(*) AS n FROM mem WHERE {LIVE} GROUP BY 1")
def count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return filters.status(records(spark, d), "active").groupBy("data_type").agg(F.count("*").alias("n"))


@query("list_profiles", f"""SELECT m.profile, count(*) FILTER ({LIVE}) AS active, count(*) FILTER (status = 'deleted') AS deleted, any_value(coalesce(s.n, 0)) AS summaries
FROM mem m LEFT JOIN (SELECT CASE page_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS profile, count(*) AS n FROM pages GROUP BY 1) s ON s.profile = m.profile GROUP BY m.profile""")
def list_profiles(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").selectExpr("case page_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as profile")
    return aggregates.profiles(records(spark, d), pages)


@query("groups_multi", "SELECT data_type, data_id, count(*) AS n FROM mem WHERE status = 'active' GROUP BY 1, 2 HAVING count(*) > 1")
def groups_multi(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("status = 'active'").groupBy("data_type", "data_id").agg(F.count("*").alias("n")).where("n > 1")


@query("extraction_stats", """
WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000), r AS (SELECT * FROM l WHERE user_id % 3 = 0 ORDER BY ts DESC, event_id DESC LIMIT 200)
SELECT event_type AS hook, count(*) AS runs, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS stored FROM r GROUP BY 1""", mem=False)
def extraction_stats(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.ledger(table(spark, d, "events"), 5000, 200, F.col("user_id") % 3 == 0)


@query("retrieval_stats", f"""SELECT count(*) AS n, count(*) FILTER (reference_count > 0) AS used,
 CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0::DOUBLE * count(*) FILTER (reference_count > 0) / count(*), 1) END AS used_pct, count(*) FILTER (embedding IS NULL) = count(*) AS degraded FROM mem WHERE {LIVE}""")
def retrieval_stats(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.usage(filters.status(records(spark, d), "active"))


@query("sync_check", f"""SELECT (SELECT count(*) FROM mem WHERE {LIVE}) AS stored, (SELECT count(*) FROM mem WHERE {LIVE} AND embedding IS NOT NULL) AS indexed,
 (SELECT count(*) FROM mem WHERE {LIVE} AND embedding IS NULL) AS no_vector, (SELECT count(*) FROM mem WHERE {LIVE} AND len(embedding) <> 64) AS wrong_size,
 (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT uuid FROM mem WHERE {LIVE})) AS orphans""")
def sync_check(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.sync(filters.status(records(spark, d), "active"), table(spark, d, "embeddings").select(F.col("vec_id").alias("uuid")), 64)


@query("maintenance_due", "SELECT max(doc_id) AS seq, max(doc_id) - 100 >= 10 AS due, (SELECT count(*) FROM documents) - (SELECT count(*) FROM embeddings) >= greatest(5, 0.02 * count(*)) AS rebuild FROM documents", mem=False)
def maintenance_due(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.maintenance_due(table(spark, d, "documents"), table(spark, d, "embeddings"), anchor=100, least=10)


@query("prefetch_conversion", "SELECT count(*) AS injected, count(*) FILTER (event_type = 'purchase') AS used, round(100.0::DOUBLE * count(*) FILTER (event_type = 'purchase') / count(*), 1) AS pct FROM events", mem=False)
def prefetch_conversion(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.conversion(table(spark, d, "events"), F.col("event_type") == "purchase")


@query("session_tags", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS tag FROM conversations WHERE role <> 'system'", mem=False)
def session_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role <> 'system'")
    return rows.select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("tag"))


for _sort, _order in (("created_at", "created_at DESC"), ("priority", "priority DESC, created_at DESC"), ("trust", "trust_score DESC, created_at DESC")):

    @query(f"list_{_sort.split('_')[0]}", f"SELECT uuid, priority, trust_score, created_at FROM mem WHERE {LIVE} ORDER BY {_order}, uuid LIMIT 50")
    def _list(spark: SparkSession, d: str, s: str = _sort) -> DataFrame:
        return filters.browse(filters.status(records(spark, d), "active"), s, 50).select("uuid", "priority", "trust_score", "created_at")


@query("taxonomy_known", "SELECT unnest(list_sort(list_distinct(list_concat(['USER-DATA','ENV-DATA','SESSION-DATA','SYSTEM','CUSTOM','OBSIDIAN','CODE'], (SELECT list(DISTINCT upper(data_id)) FROM mem))))) AS name")
def taxonomy_known(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.known_types(records(spark, d).select(F.upper("data_id").alias("name")))


@query("vector_owners", "SELECT doc_id % 50 AS point, string_agg(DISTINCT profile, ',' ORDER BY profile) AS owners FROM (SELECT uuid AS doc_id, profile FROM mem WHERE status = 'active') GROUP BY 1")
def vector_owners(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).where("status = 'active'").select((F.col("uuid") % 50).alias("point"), "profile")
    return rows.groupBy("point").agg(F.array_join(F.array_sort(F.collect_set("profile")), ",").alias("owners"))


@query("embed_hash")
def embed_hash(spark: SparkSession, d: str) -> DataFrame:
    return exchange.hashed_embedding(records(spark, d).select("uuid", "content"), 32)


@query("ingest_md_parse")
def ingest_md_parse(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.concat(F.lit("page"), "page_id", F.lit(".md")).alias("path"), F.concat(F.lit("---\ntitle: t"), "page_id", F.lit("\ntags: [a, b]\n---\n"), "html").alias("body"))
    return exchange.parse_markdown(pages).select("path", "title", F.size("links").alias("n_links"), F.length("text").alias("chars"))


@query("unpack_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm FROM embeddings", mem=False)
def unpack_vectors(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.vector import unpacked

    rows = table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").cast("binary").alias("blob"), "embedding")
    return rows.select("vec_id", F.round(dot(unpacked(F.col("blob")), F.col("embedding")), 4).alias("norm"))
