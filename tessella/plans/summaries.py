"""Summaries made from the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import summaries as S
from ..sources import postings
from ..sources.records import NOW, now, table
from .registry import query

#: 40 pages share a URL, so that identity has something to decide.
SQL = r"""s AS (SELECT page_id, concat('https://example.org/p/', page_id % 210) AS source_url, CASE page_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS profile_name,
 regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS full_text, TIMESTAMP '2026-01-01 00:00:00' - to_days(CAST(page_id * 13 % 120 AS INTEGER)) AS created_at FROM pages)"""


def summaries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("https://example.org/p/"), F.col("page_id") % 210).alias("source_url"), F.expr("case page_id % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end").alias("profile_name"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("full_text"),
        F.expr(f"timestamp_ntz'{NOW}' - make_dt_interval(cast(page_id * 13 % 120 as int))").alias("created_at"),
    )


@query("summaries_scope", f"WITH {SQL} SELECT page_id FROM s WHERE profile_name = 'beta'")
def summaries_scope(spark: SparkSession, d: str) -> DataFrame:
    return S.in_scope(summaries(spark, d), "own", "beta").select("page_id")


@query("summaries_dedup_migration", f"WITH {SQL} SELECT page_id, source_url FROM s QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY created_at DESC, page_id DESC) = 1")
def summaries_dedup_migration(spark: SparkSession, d: str) -> DataFrame:
    return S.first_wins(summaries(spark, d), F.desc("created_at"), F.desc("page_id")).select("page_id", "source_url")


@query("summaries_page", f"WITH {SQL} SELECT page_id, count(*) OVER () AS total FROM s WHERE profile_name = 'alpha' ORDER BY created_at DESC, page_id LIMIT 20 OFFSET 20")
def summaries_page(spark: SparkSession, d: str) -> DataFrame:
    return S.page(S.in_scope(summaries(spark, d), "own", "alpha"), 20, 20).select("page_id", "total")


@query("summaries_expiring", f"WITH {SQL} SELECT page_id, created_at FROM s WHERE profile_name = 'beta' AND epoch(TIMESTAMP '2026-01-01 00:00:00' - created_at) / 86400.0 >= 30 ORDER BY created_at, page_id")
def summaries_expiring(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.time import age_seconds

    old = S.in_scope(summaries(spark, d), "own", "beta").where(age_seconds(F.col("created_at"), now()) / 86400.0 >= 30)
    return old.orderBy("created_at", "page_id").select("page_id", "created_at")


@query("summaries_search", rf"""WITH {SQL}, q AS (SELECT unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+')) AS term FROM s WHERE page_id = 0),
h AS (SELECT page_id, len(list_filter(regexp_extract_all(lower(concat(title, ' ', full_text)), '[\p{{L}}\p{{N}}]+'), lambda t: list_contains(terms, t))) AS hits FROM s, (SELECT list(term) AS terms FROM q)) SELECT page_id, hits FROM h WHERE hits > 0 ORDER BY hits DESC, page_id LIMIT 20""")
def summaries_search(spark: SparkSession, d: str) -> DataFrame:
    rows = summaries(spark, d)
    terms = rows.where("page_id = 0").select(tokens(F.col("title")).alias("terms"))  # the query, one row
    words = tokens(F.concat("title", F.lit(" "), "full_text"))
    hits = rows.join(F.broadcast(terms), F.size("terms") > 0).withColumn("hits", F.size(F.filter(words, lambda t: F.array_contains(F.col("terms"), t))))
    return hits.where("hits > 0").orderBy(F.desc("hits"), "page_id").limit(20).select("page_id", "hits")


@query("summaries_stemmed")
def summaries_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The best summaries for the title of the first one; no SQL, as that knows no stems. Tests hold it against an embedded database's search."""
    rows = summaries(spark, d)
    index = postings.of_tables(S.indexed(rows), d, ("pages",), S.stemmed_words, "stems")
    asked = rows.where("page_id = 0").select("title").first()
    return S.search_stems(rows, index, asked.title if asked else "", 20).select("page_id", "score", "snippet")


@query("summaries_upsert", f"WITH {SQL}, o AS (SELECT source_url, min(page_id) AS old FROM s WHERE page_id < 100 GROUP BY 1), n AS (SELECT source_url, min(page_id) AS page_id FROM s WHERE page_id >= 100 GROUP BY 1) SELECT n.source_url, coalesce(old, page_id) AS page_id, CASE WHEN old IS NULL THEN 'added' ELSE 'already_exists' END AS outcome FROM n LEFT JOIN o ON o.source_url = n.source_url")
def summaries_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = summaries(spark, d)
    return S.upserted(rows.where("page_id < 100"), rows.where("page_id >= 100"))


@query("summaries_batch_delete", f"WITH {SQL}, a AS (SELECT k AS page_id, count(*) AS n FROM (SELECT unnest([page_id, page_id + 100000]) AS k FROM s WHERE page_id % 10 = 0 UNION ALL SELECT page_id FROM s WHERE page_id % 20 = 0) GROUP BY 1) SELECT count(*) FILTER (profile_name = 'alpha') AS deleted, count(*) FILTER (profile_name IS NOT NULL AND profile_name <> 'alpha') AS \"foreign\", count(*) FILTER (profile_name IS NULL) AS missing, CAST(sum(n - 1) AS BIGINT) AS repeated FROM a LEFT JOIN s ON s.page_id = a.page_id")
def summaries_batch_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = summaries(spark, d)
    asked = rows.where("page_id % 10 = 0").select(F.explode(F.expr("array(page_id, page_id + 100000)")).alias("page_id")).union(rows.where("page_id % 20 = 0").select("page_id"))
    return S.batch_delete(rows, asked, "alpha")


@query("summaries_sync", f"WITH {SQL} SELECT profile_name, count(*) AS n, count(*) FILTER (title = '') AS untitled, count(DISTINCT source_url) < count(*) AS repeated FROM s GROUP BY 1")
def summaries_sync(spark: SparkSession, d: str) -> DataFrame:
    rows = summaries(spark, d).groupBy("profile_name")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("title") == "").alias("untitled"), (F.count_distinct("source_url") < F.count("*")).alias("repeated"))


@query("summaries_deleted", f"WITH {SQL}, a AS (SELECT page_id FROM s WHERE page_id % 4 = 0) SELECT page_id, source_url FROM s WHERE NOT (profile_name = 'beta' AND page_id IN (SELECT page_id FROM a))")
def summaries_deleted(spark: SparkSession, d: str) -> DataFrame:
    rows = summaries(spark, d)
    asked = rows.where("page_id % 4 = 0").select(F.explode(F.expr("array(page_id, page_id, -1 - page_id)")).alias("page_id"))
    return S.deleted(rows, asked, "own", "beta")[0].select("page_id", "source_url")


#: Every fifth file is gone, and every tenth row has no text of its own.
_FILES = "t AS (SELECT page_id, profile_name, CASE WHEN page_id % 3 = 1 AND page_id % 7 = 0 THEN NULL ELSE concat('s/', page_id, '.md') END AS summary_path, page_id % 5 <> 0 AS there, CASE WHEN page_id % 10 = 0 THEN '' ELSE full_text END AS full_text FROM s)"


def _with_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    named = F.concat(F.lit("s/"), "page_id", F.lit(".md"))
    rows = summaries(spark, d).withColumn("summary_path", F.when(~F.expr("page_id % 3 = 1 and page_id % 7 = 0"), named)).withColumn("full_text", F.when(F.col("page_id") % 10 == 0, "").otherwise(F.col("full_text")))
    return rows, rows.where("page_id % 5 <> 0").select(named.alias("path"))


@query("summaries_sync_outcomes", f"WITH {SQL}, {_FILES} SELECT page_id, CASE WHEN profile_name <> 'beta' THEN 'foreign' WHEN there THEN 'kept' WHEN full_text <> '' THEN 'preserved' ELSE 'orphaned' END AS outcome FROM t WHERE summary_path IS NOT NULL")
def summaries_sync_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return S.sync_outcomes(*_with_files(spark, d), "all", "beta")


@query("summaries_synced", f"WITH {SQL}, {_FILES} SELECT page_id, CASE WHEN profile_name <> 'beta' OR there THEN summary_path END AS summary_path FROM t WHERE NOT coalesce(profile_name = 'beta' AND summary_path IS NOT NULL AND NOT there AND full_text = '', false)")
def summaries_synced(spark: SparkSession, d: str) -> DataFrame:
    rows, files = _with_files(spark, d)
    return S.synced(rows, S.sync_outcomes(rows, files, "own", "beta")).select("page_id", "summary_path")
