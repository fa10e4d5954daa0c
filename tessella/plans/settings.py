"""Settings and taxonomy, changed by requests that the events stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import settings as S
from ..sources.records import table
from .registry import query

_KEY = "CASE user_id % 10 WHEN 0 THEN 'dedup_threshold' WHEN 1 THEN 'max_layer' WHEN 2 THEN 'tracing' ELSE concat('user-', user_id) END"
_CONFIG = f"""q AS (SELECT event_id AS seq, {_KEY} AS key, CASE WHEN event_type IN ('click', 'signup') THEN 'delete' ELSE 'set' END AS action, event_id % 7 AS v FROM events),
b AS (SELECT DISTINCT concat('user-', user_id) AS key, CASE WHEN user_id % 6 = 0 THEN concat('e', user_id) END AS env, CASE WHEN user_id % 2 = 0 THEN concat('f', user_id) END AS file FROM events),
p AS (SELECT seq, q.key, action, v, env, file, action = 'set' AND NOT (q.key IN ('dedup_threshold', 'tracing') AND v > 1 OR q.key = 'max_layer' AND v > 4) AS ok FROM q LEFT JOIN b ON b.key = q.key),
w AS (SELECT *, coalesce(last_value(CASE WHEN ok THEN true WHEN action = 'delete' THEN false END IGNORE NULLS) OVER e, false) AS held, coalesce(bool_or(ok) OVER e, false) AS was FROM p
 WINDOW e AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_NAME = "concat(CASE WHEN user_id % 11 = 0 THEN '-' ELSE '' END, event_type, '.', user_id)"
_KIND = "CASE event_id % 5 WHEN 0 THEN 'data_type' WHEN 1 THEN 'data_type' WHEN 2 THEN 'data_id' WHEN 4 THEN 'data_typo' END"
_TAXONOMY = f"""q AS (SELECT event_id AS seq, {_NAME} AS name, CASE WHEN event_id % 3 = 0 THEN 'unregister' ELSE 'register' END AS action, {_KIND} AS kind, CASE WHEN event_id % 2 = 0 THEN 'extra' END AS collection, CAST(event_id AS VARCHAR) AS description FROM events),
f AS (SELECT *, CASE action WHEN 'register' THEN coalesce(kind IN ('data_type', 'data_id'), false) AND name[1] <> '-' ELSE coalesce(kind, 'data_id') IN ('data_type', 'data_id') END AS fit FROM q),
x AS (SELECT seq, name, action, fit, collection, description, unnest(CASE WHEN kind IS NULL THEN ['data_type', 'data_id'] ELSE [kind] END) AS kind FROM f)"""


def _config(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    requests = events.select(
        F.col("event_id").alias("seq"), F.expr(_KEY).alias("key"), F.when(F.col("event_type").isin("click", "signup"), "delete").otherwise("set").alias("action"), (F.col("event_id") % 7).cast("string").alias("value")
    )
    users = events.select("user_id").distinct()
    layer = lambda name, n: users.where(F.col("user_id") % n == 0).select(F.concat(F.lit("user-"), "user_id").alias("key"), F.lit(name).alias("layer"), F.concat(F.lit(name[0]), "user_id").alias("value"))
    return requests, layer("env", 6).union(layer("file", 2))


@query("config_changes", f"""WITH {_CONFIG} SELECT seq, key, CASE WHEN ok THEN 'updated' WHEN action = 'set' THEN 'error' WHEN held THEN 'deleted' WHEN env IS NOT NULL OR file IS NOT NULL AND NOT was THEN 'not_a_runtime_override' ELSE 'not_found' END AS status,
 CASE WHEN ok THEN CAST(v AS VARCHAR) WHEN action = 'set' THEN CASE key WHEN 'tracing' THEN 'not of kind bool' WHEN 'max_layer' THEN 'not from 0 to 4' ELSE 'not from 0 to 1' END WHEN held THEN env END AS value FROM w""", mem=False)
def config_changes(spark: SparkSession, d: str) -> DataFrame:
    return S.config_changes(*_config(spark, d))


@query("config_now", f"""WITH {_CONFIG}, l AS (SELECT key, arg_max(ok, seq) AS live, arg_max(v, seq) AS v FROM w WHERE ok OR action = 'delete' AND held GROUP BY 1),
j AS (SELECT coalesce(l.key, b.key) AS key, live, v, env, file, CASE WHEN live THEN 'runtime' WHEN env IS NOT NULL THEN 'env' WHEN live IS NULL AND file IS NOT NULL THEN 'file' END AS layer FROM l FULL JOIN b ON b.key = l.key)
SELECT key, CASE layer WHEN 'runtime' THEN CAST(v AS VARCHAR) WHEN 'env' THEN env ELSE file END AS value, layer FROM j WHERE layer IS NOT NULL""", mem=False)
def config_now(spark: SparkSession, d: str) -> DataFrame:
    return S.config_now(*_config(spark, d))


def _taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.expr(_NAME).alias("name"), F.when(F.col("event_id") % 3 == 0, "unregister").otherwise("register").alias("action"), F.expr(_KIND).alias("kind"),
        F.when(F.col("event_id") % 2 == 0, "extra").alias("collection"), F.col("event_id").cast("string").alias("description"),
    )


@query("taxonomy_changes", f"""WITH {_TAXONOMY}, w AS (SELECT *, coalesce(last_value(CASE WHEN fit THEN action = 'register' END IGNORE NULLS) OVER (PARTITION BY name, kind ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS held FROM x)
SELECT seq, min(name) AS name, CASE WHEN NOT bool_and(fit) THEN 'error' WHEN min(action) = 'register' THEN 'registered' WHEN bool_or(held) THEN 'unregistered' ELSE 'not_found' END AS status FROM w GROUP BY seq""", mem=False)
def taxonomy_changes(spark: SparkSession, d: str) -> DataFrame:
    return S.taxonomy_changes(_taxonomy(spark, d))


@query("taxonomy_now", f"""WITH {_TAXONOMY}, l AS (SELECT * FROM x WHERE fit QUALIFY row_number() OVER (PARTITION BY name, kind ORDER BY seq DESC) = 1)
SELECT name, kind, CASE WHEN kind = 'data_type' THEN coalesce(collection, 'memories') ELSE collection END AS collection, description FROM l WHERE action = 'register'""", mem=False)
def taxonomy_now(spark: SparkSession, d: str) -> DataFrame:
    return S.taxonomy_now(_taxonomy(spark, d))
