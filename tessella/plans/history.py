"""History and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import metrics as M
from ..operators.graph import top_matches
from ..sources.records import table
from .registry import query


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("history_current_state", "SELECT user_id, arg_max(event_id, {'a': ts, 'b': event_id}) AS event_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type FROM events GROUP BY 1", mem=False)
def history_current_state(spark: SparkSession, d: str) -> DataFrame:
    return H.current_state(_events(spark, d))


@query("rolling_budget", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS calls, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) > 2 AS over FROM events", mem=False)
def rolling_budget(spark: SparkSession, d: str) -> DataFrame:
    return H.rolling_calls(_events(spark, d), 2)


@query("throttle_turns")
def throttle_turns(spark: SparkSession, d: str) -> DataFrame:
    return H.throttled(_events(spark, d).select("user_id", "event_id", "ts"))


@query("breaker_states")
def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    return H.breaker_states(_events(spark, d).select("user_id", "event_id", "ts", "event_type"))


@query("session_tail", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id, count(*) AS n, string_agg(concat(role, ': ', left(text, 2000)), chr(10) ORDER BY turn) AS tail FROM r WHERE rn <= 40 GROUP BY 1", mem=False)
def session_tail(spark: SparkSession, d: str) -> DataFrame:
    return H.session_tail(table(spark, d, "conversations"))


_RANKED = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), r AS (SELECT a.vec_id AS q, a.label AS ql, b.vec_id AS uuid, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.vec_id) AS rank FROM e a, e b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 20)"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("embedding").alias("v"))
    rows = e.select(F.col("vec_id").alias("uuid"), "embedding")
    top = top_matches(rows.join(q.select(F.col("q").alias("uuid")), "uuid", "left_semi"), rows, 20)
    labels = e.select(F.col("vec_id").alias("match"), "label")
    return top.join(labels, "match").join(q.select(F.col("q").alias("uuid"), "ql"), "uuid").select(F.col("uuid").alias("q"), "ql", F.col("match").alias("uuid"), "label", "rank")


@query("metric_recall_mrr", f"WITH {_RANKED}, t AS (SELECT q, min(rank) FILTER (label = ql) AS rank FROM r GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM t", mem=False)
def metric_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    # every record of the query's label is expected, so labels are compared instead of laying out the pairs
    first = _results(spark, d).groupBy("q").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("rank"))
    return M.of_first_hits(first, 5)


@query("metric_noise", f"WITH {_RANKED} SELECT round(avg(CASE WHEN label <> ql THEN 1.0::DOUBLE ELSE 0 END), 6) AS noise, count(DISTINCT q) AS n FROM r WHERE rank <= 5", mem=False)
def metric_noise(spark: SparkSession, d: str) -> DataFrame:
    top = _results(spark, d).where("rank <= 5")
    return top.agg(F.round(F.avg(F.when(F.col("label") != F.col("ql"), 1.0).otherwise(0.0)), 6).alias("noise"), F.count_distinct("q").alias("n"))


@query("metric_dedup", f"WITH {_RANKED}, t AS (SELECT q % 2 = 0 AS said, label = ql AS truth FROM r), c AS (SELECT count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, count(*) FILTER (NOT said AND NOT truth) AS tn FROM t) SELECT *, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall FROM c", mem=False)
def metric_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d).select((F.col("q") % 2 == 0).alias("said"), (F.col("label") == F.col("ql")).alias("truth"))
    return M.confusion(rows)


@query("metric_pairs", """WITH g AS (SELECT vec_id % 12 AS grp, label FROM embeddings), c AS (SELECT grp, label, count(*) AS n FROM g GROUP BY 1, 2), a AS (SELECT grp, sum(n) AS g, max(n) AS top FROM c GROUP BY 1), l AS (SELECT label, sum(n) AS l FROM c GROUP BY 1)
SELECT round((SELECT sum(n * (n - 1) / 2) FROM c) / (SELECT sum(g * (g - 1) / 2) FROM a), 6) AS precision, round((SELECT sum(n * (n - 1) / 2) FROM c) / (SELECT sum(l * (l - 1) / 2) FROM l), 6) AS recall, round((SELECT sum(top) FROM a) / (SELECT sum(g) FROM a)::DOUBLE, 6) AS purity""", mem=False)
def metric_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.pair_quality(table(spark, d, "embeddings").select((F.col("vec_id") % 12).alias("grp"), "label"))


_GATE = "SELECT event_type AS metric, round(avg(value) FILTER ({}), 6) AS {} FROM events GROUP BY 1"


@query("metric_gate", f"WITH o AS ({_GATE.format('event_id % 2 = 0', 'old')}), n AS ({_GATE.format('event_id % 2 = 1', 'new')}) SELECT metric, old, new, new >= old * 0.95::DOUBLE AS passed FROM o JOIN n USING (metric)", mem=False)
def metric_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each event type's mean value in one half of the events against the other half's as the baseline."""
    means = lambda odd: table(spark, d, "events").where(F.col("event_id") % 2 == odd).groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    return M.gate(means(1), means(0))


@query("gen_filler", "SELECT doc_id AS i, concat('service ', source, ' ', doc_id, ' listens on port ', 8000 + doc_id % 900, ' with ', (doc_id % 12 + 1) * 8, ' GB and ', doc_id % 8 + 2, ' cores') AS content, (doc_id * 37) % 400 AS age_days, round(0.2::DOUBLE + ((doc_id * 17) % 70) / 100.0::DOUBLE, 4) AS trust FROM documents", mem=False)
def gen_filler(spark: SparkSession, d: str) -> DataFrame:
    """A filler record for each document, spread over ages and trust by its id."""
    i = F.col("doc_id")
    text = F.concat(F.lit("service "), F.coalesce("source", F.lit("")), F.lit(" "), i, F.lit(" listens on port "), 8000 + i % 900, F.lit(" with "), (i % 12 + 1) * 8, F.lit(" GB and "), i % 8 + 2, F.lit(" cores"))
    return table(spark, d, "documents").select(i.alias("i"), text.alias("content"), (i * 37 % 400).alias("age_days"), F.expr("round(0.2D + ((doc_id * 17) % 70) / 100.0D, 4)").alias("trust"))
