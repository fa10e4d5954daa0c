"""Mutation and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TRUSTED_SOURCES
from ..operators import filters
from ..operators import graph as G
from ..operators import lifecycle as L
from ..operators import validation as V
from ..sources.records import now, records, table
from .graph import COS, DUP, POSSIBLE
from .registry import query

LIVE = "status = 'active' AND superseded_by IS NULL"
_AGE = "floor(epoch(TIMESTAMP '2026-01-01 00:00:00' - created_at) / 86400.0)"
_HOURS = "epoch(TIMESTAMP '2026-01-01 00:00:00' - {}) / 3600.0"


@query("decay", f"""SELECT uuid, trust_score, round(greatest(0.1::DOUBLE, trust_score * (1 - 0.1::DOUBLE * CASE priority WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.2::DOUBLE ELSE 0 END
 * CASE WHEN reference_count > 10 THEN 0.3::DOUBLE ELSE 1 END * least({_AGE} / 365.0::DOUBLE, 1.0))), 4) AS decayed FROM mem WHERE status = 'active' AND NOT protected AND trust_score <= 0.9 AND {_AGE} >= 30""")
def decay(spark: SparkSession, d: str) -> DataFrame:
    return L.decayed(records(spark, d), now())


@query("sleep_ttl", "SELECT uuid, 'ttl' AS reason FROM mem WHERE status = 'active' AND ttl <= TIMESTAMP '2026-01-01 00:00:00'")
def sleep_ttl(spark: SparkSession, d: str) -> DataFrame:
    return L.sleep_expired(records(spark, d), now())


@query("sleep_low_trust_dupes", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY data_type, data_id ORDER BY trust_score DESC, priority DESC, uuid) AS rn FROM mem WHERE status = 'active' AND NOT protected)
SELECT uuid, 'low_trust_duplicate' AS reason FROM r WHERE rn > 1 AND trust_score < 0.2 AND {_HOURS.format('created_at')} >= 24""")
def sleep_low_trust_dupes(spark: SparkSession, d: str) -> DataFrame:
    return L.sleep_duplicates(records(spark, d), now())


@query("sleep_low_trust_old", f"SELECT uuid, 'low_trust_old' AS reason FROM mem WHERE status = 'active' AND NOT protected AND priority < 2 AND trust_score < 0.3 AND {_AGE} > 365")
def sleep_low_trust_old(spark: SparkSession, d: str) -> DataFrame:
    return L.sleep_old(records(spark, d), now())


@query("purge_survivors", f"SELECT uuid, status FROM mem WHERE NOT ((status = 'deleted' AND {_HOURS.format('updated_at')} >= 24) OR (status = 'archived' AND {_HOURS.format('updated_at')} >= 168))")
def purge_survivors(spark: SparkSession, d: str) -> DataFrame:
    return L.purge_survivors(records(spark, d), now()).select("uuid", "status")


@query("update_batch", """SELECT m.uuid, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'edited' ELSE content END AS content, CASE WHEN l.doc_id IS NOT NULL THEN l.toxic ELSE sensitivity END AS sensitivity,
 CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 AND source = 'user-stated' THEN 'agent' ELSE source END AS source, CASE WHEN l.doc_id IS NOT NULL THEN TIMESTAMP '2026-01-01 00:00:00' ELSE updated_at END AS updated_at FROM mem m LEFT JOIN labels l ON l.doc_id = m.uuid""")
def update_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    changes = table(spark, d, "labels").selectExpr("doc_id as uuid", "case when quality = 1 then 'edited' end as content", "cast(toxic as bigint) as sensitivity")
    return L.updated(rows, changes, ("content", "sensitivity"), now()).select("uuid", "content", "sensitivity", "source", "updated_at")


@query("delete_batch", "SELECT m.uuid, CASE WHEN l.doc_id IS NOT NULL THEN 'deleted' ELSE status END AS status, CASE WHEN s.doc_id IS NULL THEN superseded_by END AS superseded_by FROM mem m LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = m.uuid LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) s ON s.doc_id = m.superseded_by")
def delete_batch(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("uuid"))
    return L.deleted(records(spark, d), ids).select("uuid", "status", "superseded_by")


@query("feedback_apply", "SELECT m.uuid, round(greatest(0, least(1, trust_score + 0.1::DOUBLE * n)), 4) AS trust_score FROM mem m JOIN (SELECT doc_id, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END) AS n FROM labels GROUP BY 1) v ON v.doc_id = m.uuid")
def feedback_apply(spark: SparkSession, d: str) -> DataFrame:
    votes = table(spark, d, "labels").selectExpr("doc_id as uuid", "quality = 1 as helpful")
    return L.feedback(records(spark, d), votes)


@query("reference_counts", "SELECT user_id AS uuid, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1", mem=False)
def reference_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("uuid")).agg(F.count("*").alias("n"))


@query("marker_cleanup", "SELECT uuid FROM mem WHERE status = 'active' AND NOT protected AND starts_with(content, 'The ')")
def marker_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return L.unmarked(records(spark, d), "The ").select("uuid")


@query("rebuild_worklist", f"SELECT uuid, embedding IS NULL AS missing FROM mem WHERE {LIVE} AND (embedding IS NULL OR len(embedding) <> 64)")
def rebuild_worklist(spark: SparkSession, d: str) -> DataFrame:
    live = filters.status(records(spark, d), "active")
    return live.where("embedding is null or size(embedding) <> 64").select("uuid", F.col("embedding").isNull().alias("missing"))


@query("review_apply", "SELECT uuid, CASE WHEN uuid % 6 = 1 AND NOT protected THEN 'deleted' ELSE status END AS status FROM mem WHERE status = 'active'")
def review_apply(spark: SparkSession, d: str) -> DataFrame:
    # verdict lines as a reviewer would send them: 'id: verdict'
    lines = records(spark, d).select(F.concat(F.col("uuid"), F.lit(": "), F.when(F.col("uuid") % 6 == 1, "DELETE").otherwise("keep")).alias("line"))
    verdicts = lines.select(F.split("line", ": ")[0].cast("long").alias("uuid"), F.lower(F.split("line", ": ")[1]).alias("verdict"))
    rows = records(spark, d).where("status = 'active'").join(verdicts, "uuid", "left")
    return rows.select("uuid", F.when((F.col("verdict") == "delete") & ~F.col("protected"), "deleted").otherwise(F.col("status")).alias("status"))


@query("merge_group_fields", """WITH g AS (SELECT *, uuid % 40 AS grp FROM mem WHERE status = 'active'),
t AS (SELECT grp, data_type FROM (SELECT grp, data_type, count(*) AS n, min(uuid) AS pos FROM g GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, pos) = 1),
i AS (SELECT grp, data_id FROM (SELECT grp, data_id, count(*) AS n, min(uuid) AS pos FROM g GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY n DESC, pos) = 1)
SELECT g.grp, any_value(t.data_type) AS data_type, any_value(i.data_id) AS data_id, round(least(1, max(trust_score) + 0.05::DOUBLE), 4) AS trust_score, min(created_at) AS first_observed_at, max(sensitivity) AS sensitivity, bool_or(protected) AS protected,
 CASE WHEN count(ttl) = count(*) THEN max(ttl) END AS ttl, count(*) AS n FROM g JOIN t ON t.grp = g.grp JOIN i ON i.grp = g.grp GROUP BY g.grp""")
def merge_group_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).where("status = 'active'").withColumn("grp", F.col("uuid") % 40).withColumn("pos", F.col("uuid"))
    return L.merged_fields(rows)


_IN = "inc AS (SELECT uuid + CASE WHEN uuid % 3 = 0 THEN 100000 ELSE 0 END AS uuid, concat('new ', content) AS content, source FROM mem), clm AS (SELECT uuid, content, CASE WHEN source IN ('agent', 'consolidated', 'user-stated') THEN 'import' ELSE source END AS source FROM inc), old AS (SELECT uuid, content, source FROM mem)"
_MODES = {
    "skip_existing": "SELECT * FROM old UNION ALL SELECT * FROM clm WHERE uuid NOT IN (SELECT uuid FROM old)",
    "overwrite": "SELECT * FROM old WHERE uuid NOT IN (SELECT uuid FROM clm) UNION ALL SELECT * FROM clm",
    "new_uuid": "SELECT * FROM old UNION ALL SELECT CASE WHEN uuid IN (SELECT uuid FROM old) THEN (SELECT greatest((SELECT max(uuid) FROM old), (SELECT max(uuid) FROM clm))) + 1 + uuid ELSE uuid END, content, source FROM clm",
}
for _mode, _sql in _MODES.items():

    @query(f"import_{_mode}", f"WITH {_IN} {_sql}")
    def _import(spark: SparkSession, d: str, mode: str = _mode) -> DataFrame:
        rows = records(spark, d)
        incoming = rows.selectExpr("uuid + case when uuid % 3 = 0 then 100000 else 0 end as uuid", "concat('new ', content) as content", "source")
        return L.imported(rows, incoming, mode, TRUSTED_SOURCES)


_SIM = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query("add_batch_verdicts", f"""WITH n AS (SELECT a.uuid AS uuid, max({_SIM}) AS sim FROM mem a JOIN mem b ON a.data_type = b.data_type AND a.uuid <> b.uuid WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND b.{LIVE.replace('superseded_by', 'b.superseded_by')} GROUP BY 1)
SELECT m.uuid, CASE WHEN length(content) > 50000 THEN 'rejected' WHEN sim >= {DUP} THEN 'duplicate' WHEN sim >= {POSSIBLE} THEN 'possible_duplicate' ELSE 'added' END AS verdict FROM mem m LEFT JOIN n ON n.uuid = m.uuid""")
def add_batch_verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    reasons = records(spark, d, vectors=False).select("uuid", V.reject_reason().alias("reason"))
    near = G.near_verdict(F.col("sim"), DUP, POSSIBLE)
    verdict = F.when(F.col("reason").isNotNull(), "rejected").when(near == "new", "added").otherwise(near)
    return reasons.join(G.best_matches(rows, filters.status(rows, "active")), "uuid", "left").select("uuid", verdict.alias("verdict"))


@query("extraction_routing", f"""WITH n AS (SELECT a.uuid AS uuid, max({_SIM}) AS sim FROM mem a JOIN mem b ON a.data_type = b.data_type AND a.uuid <> b.uuid WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND b.{LIVE.replace('superseded_by', 'b.superseded_by')} GROUP BY 1),
e AS (SELECT a.uuid, max({_SIM}) >= 0.3 AS echo FROM mem a, mem b WHERE b.uuid % 100 = 0 AND a.uuid <> b.uuid AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL GROUP BY 1)
SELECT m.uuid, CASE WHEN echo THEN 'echo' WHEN sim >= {DUP} THEN 'reject' ELSE 'store' END AS route FROM mem m LEFT JOIN n ON n.uuid = m.uuid LEFT JOIN e ON e.uuid = m.uuid""")
def extraction_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    near = G.dedup_verdict(rows, filters.status(rows, "active"), DUP, POSSIBLE).select("uuid", "verdict")
    heard = G.echoes(rows.where("embedding is not null"), rows.where("uuid % 100 = 0 and embedding is not null"), COS).select("uuid", "echo")
    route = F.when(F.col("echo"), "echo").when(F.col("verdict") == "duplicate", "reject").otherwise("store")
    return near.join(heard, "uuid", "left").select("uuid", route.alias("route"))


@query("enrich_worklist", "WITH a AS (SELECT uuid, 1 AS pass FROM mem WHERE status = 'active' AND len(keywords) < 5), b AS (SELECT uuid, 2 AS pass FROM mem WHERE status = 'active' AND embedding IS NULL AND uuid NOT IN (SELECT uuid FROM a)) SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY pass, uuid LIMIT 400")
def enrich_worklist(spark: SparkSession, d: str) -> DataFrame:
    live = records(spark, d).where("status = 'active'")
    first = live.where("size(keywords) < 5").select("uuid", F.lit(1).alias("pass"))
    second = live.where("embedding is null").join(first, "uuid", "left_anti").select("uuid", F.lit(2).alias("pass"))
    return first.union(second).orderBy("pass", "uuid").limit(400)


@query("reenrich_worklist", "SELECT uuid FROM mem WHERE status = 'active' AND source = 'import' ORDER BY created_at, uuid LIMIT 100")
def reenrich_worklist(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("status = 'active' and source = 'import'").orderBy("created_at", "uuid").limit(100).select("uuid")


@query("surfaced_inventory", f"SELECT uuid, left(summary, 120) AS line FROM mem WHERE {LIVE} ORDER BY uuid LIMIT 40")
def surfaced_inventory(spark: SparkSession, d: str) -> DataFrame:
    return filters.status(records(spark, d), "active").orderBy("uuid").limit(40).select("uuid", F.substring("summary", 1, 120).alias("line"))


@query("classify_join", "SELECT uuid, data_type FROM mem")
def classify_join(spark: SparkSession, d: str) -> DataFrame:
    # results of a batch classifier, and as many for ids that nobody asked for
    results = records(spark, d).select(F.explode(F.array("uuid", -1 - F.col("uuid"))).alias("uuid"), "data_type")
    return records(spark, d).select("uuid").join(results, "uuid")


@query("migrate_backlinks", "SELECT uuid, list_sort(list_distinct(list_concat([data_id], list_concat(regexp_extract_all(concat('[[', topic, ']]'), '\\[\\[([^\\]]+)\\]\\]', 1), [])))) AS backlinks FROM mem")
def migrate_backlinks(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import wikilinks

    links = wikilinks(F.concat(F.lit("[["), "topic", F.lit("]]")))
    return records(spark, d).select("uuid", F.array_sort(F.array_union(F.array("data_id"), links)).alias("backlinks"))


@query("patterns_merge", "SELECT event_type AS name, min(event_id) AS place, arg_max(user_id, event_id) AS version FROM events GROUP BY 1", mem=False)
def patterns_merge(spark: SparkSession, d: str) -> DataFrame:
    """Pattern files by name in their order of arrival: a name keeps its first place and takes its last version."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("place"), F.max_by("user_id", "event_id").alias("version"))


@query("config_effective", """WITH c AS (SELECT user_id AS key, CASE event_id % 3 WHEN 0 THEN 'env' WHEN 1 THEN 'file' ELSE 'db' END AS layer, event_id, value FROM events),
l AS (SELECT key, layer, arg_max(value, event_id) AS value FROM c GROUP BY 1, 2) SELECT key, arg_min(value, CASE layer WHEN 'env' THEN 0 WHEN 'file' THEN 1 ELSE 2 END) AS value FROM l GROUP BY 1""", mem=False)
def config_effective(spark: SparkSession, d: str) -> DataFrame:
    """Settings written by events: the last one of a layer counts, and of the layers environment, file, database the first that has the key."""
    layer = F.col("event_id") % 3
    return table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.min(F.struct(layer.alias("layer"), (-F.col("event_id")).alias("e"), "value")).alias("s")).select("key", F.col("s.value").alias("value"))
