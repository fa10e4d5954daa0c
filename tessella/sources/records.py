"""The record store: one row per record, partitioned by profile.

A record's columns are those of RECORD. ``records`` derives a store from the documents
and embeddings tables, which is what the queries and their SQL run on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_tokens

NOW = "2026-01-01 00:00:00"
now = lambda: F.lit(NOW).cast("timestamp_ntz")

RECORD = (
    "uuid long, profile string, content string, summary string, topic string, data_type string, data_id string, source string, "
    "sensitivity long, priority long, protected boolean, status string, created_at timestamp_ntz, updated_at timestamp_ntz, "
    "ttl timestamp_ntz, trust_score double, reference_count long, superseded_by long, keywords array<string>, embedding array<float>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, vectors: bool = True) -> DataFrame:
    """The store; of the uuids in ``only`` (a top-k) if given, so that nothing is worked out for the others.

    Without ``vectors`` it has no embedding, and texts needn't be shuffled to join any; only where a vec_id repeats are they joined, as each of its vectors makes a row.
    """
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    if only is not None:
        d = d.join(F.broadcast(only.select(F.col("uuid").alias("_only"))), F.col("doc_id") == F.col("_only"), "left_semi")
    days = lambda expr: f"make_dt_interval(cast({expr} as int))"
    at = f"timestamp_ntz'{NOW}'"
    # all that comes of a text is worked out before the join, so that texts pass it only where they are asked for
    out = d.selectExpr(
        "doc_id as uuid", "case doc_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as profile",
        "text as content", "substring(text, 1, 100) as summary", "lang", "lower(source) as data_id",
        "element_at(array('USER-DATA', 'ENV-DATA', 'SESSION-DATA', 'SYSTEM', 'CUSTOM', 'OBSIDIAN', 'CODE'), cast(doc_id % 7 as int) + 1) as data_type",
        "element_at(array('agent', 'import', 'obsidian', 'user-stated'), cast(doc_id % 4 as int) + 1) as source",
        "case when doc_id % 5 = 0 then 1 + doc_id % 3 else 0 end as sensitivity",
        "case when doc_id % 41 = 0 then 3 else cast(floor(doc_id / 3) as bigint) % 3 end as priority",
        "doc_id % 29 = 0 as protected",
        "case when doc_id % 23 = 0 then 'deleted' when doc_id % 19 = 0 then 'archived' else 'active' end as status",
        f"{at} - {days('(doc_id * 37) % 400')} as created_at",
        f"least({at}, {at} - {days('(doc_id * 37) % 400')} + {days('doc_id % 5')}) as updated_at",
        f"case when doc_id % 13 = 0 then {at} - {days('(doc_id * 37) % 400')} + {days('90')} end as ttl",
        "round(0.05D + ((doc_id * 17) % 90) / 100.0D, 4) as trust_score", "doc_id % 15 as reference_count",
        "case when doc_id % 31 = 0 then doc_id + 1 end as superseded_by",
    )
    out = out.withColumn("words", first_tokens(F.col("content"), 5))
    out = out.withColumn("topic", F.concat(F.col("lang"), F.lit(" "), F.coalesce(F.get("words", F.lit(0)), F.lit(""))))
    out = out.withColumn("keywords", F.array_sort(F.array_distinct("words")))
    if vectors or e.groupBy("vec_id").count().where("count > 1").limit(1).count():
        out = out.join(e, F.col("uuid") == F.col("vec_id"), "left")
    return out.select(*[c.split()[0] for c in RECORD.split(", ") if vectors or not c.startswith("embedding ")])


#: The same store in DuckDB SQL, as common table expressions.
MEM_SQL = r"""
mem0 AS (SELECT d.*, e.embedding AS emb, regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+') AS tk FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
mem AS (SELECT doc_id AS uuid, CASE doc_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS profile, text AS content,
 substr(text, 1, 100) AS summary, concat(lang, ' ', coalesce(tk[1], '')) AS topic, lower(source) AS data_id,
 CASE doc_id % 7 WHEN 0 THEN 'USER-DATA' WHEN 1 THEN 'ENV-DATA' WHEN 2 THEN 'SESSION-DATA' WHEN 3 THEN 'SYSTEM' WHEN 4 THEN 'CUSTOM' WHEN 5 THEN 'OBSIDIAN' ELSE 'CODE' END AS data_type,
 CASE doc_id % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'import' WHEN 2 THEN 'obsidian' ELSE 'user-stated' END AS source,
 CASE WHEN doc_id % 5 = 0 THEN 1 + doc_id % 3 ELSE 0 END AS sensitivity,
 CASE WHEN doc_id % 41 = 0 THEN 3 ELSE (doc_id // 3) % 3 END AS priority, doc_id % 29 = 0 AS protected,
 CASE WHEN doc_id % 23 = 0 THEN 'deleted' WHEN doc_id % 19 = 0 THEN 'archived' ELSE 'active' END AS status,
 TIMESTAMP '2026-01-01 00:00:00' - to_days(CAST((doc_id * 37) % 400 AS INTEGER)) AS created_at,
 least(TIMESTAMP '2026-01-01 00:00:00', TIMESTAMP '2026-01-01 00:00:00' - to_days(CAST((doc_id * 37) % 400 AS INTEGER)) + to_days(CAST(doc_id % 5 AS INTEGER))) AS updated_at,
 CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2026-01-01 00:00:00' - to_days(CAST((doc_id * 37) % 400 AS INTEGER)) + to_days(90) END AS ttl,
 round(0.05::DOUBLE + ((doc_id * 17) % 90) / 100.0::DOUBLE, 4) AS trust_score, doc_id % 15 AS reference_count,
 CASE WHEN doc_id % 31 = 0 THEN doc_id + 1 END AS superseded_by, list_sort(list_distinct(tk[1:5])) AS keywords, emb AS embedding FROM mem0)"""
