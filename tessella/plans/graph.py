"""Conflicts, duplicates, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import filters
from ..operators import graph as G
from ..sources.records import records, table
from ..sources.scratch import checkpoints as _checkpoints  # noqa: F401
from .registry import query

LIVE = "status = 'active' AND superseded_by IS NULL"
#: Limits low enough for the vectors of the fixtures.
COS, POSSIBLE, DUP, JACC = 0.3, 0.4, 0.45, 0.0
_SIM = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
_J = "CASE WHEN len(a.keywords) > 0 AND len(b.keywords) > 0 THEN len(list_intersect(a.keywords, b.keywords))::DOUBLE / len(list_distinct(list_concat(a.keywords, b.keywords))) END"
_GUARD = """(a.data_id IS NULL OR b.data_id IS NULL OR a.data_id = b.data_id) AND abs(epoch(a.created_at) - epoch(b.created_at)) / 86400.0 >= 1
 AND NOT (a.source = b.source AND a.data_id = b.data_id AND abs(epoch(a.created_at) - epoch(b.created_at)) / 86400.0 <= 30)"""
PAIRS = f"""cp AS (SELECT a.uuid AS a, b.uuid AS b, {_SIM} AS sim FROM mem a JOIN mem b ON a.data_type = b.data_type AND a.uuid < b.uuid
 WHERE a.status = 'active' AND a.superseded_by IS NULL AND b.status = 'active' AND b.superseded_by IS NULL AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND {_SIM} >= {COS} AND {_GUARD}
 AND CASE WHEN ({_J}) IS NULL THEN {_SIM} >= 0.95 ELSE ({_J}) >= {JACC} AND ({_J}) < 1 END)"""
CC = """cn AS (SELECT a, b FROM cp UNION SELECT b, a FROM cp), rc(node, r) AS (SELECT a, a FROM cn UNION SELECT cn.b, rc.r FROM rc JOIN cn ON cn.a = rc.node), cc AS (SELECT node, min(r) AS component FROM rc GROUP BY 1)"""


def _pairs(spark: SparkSession, d: str, forest: bool = False) -> DataFrame:
    return G.conflict_pairs(filters.status(records(spark, d), "active"), COS, JACC - 1e-9, forest=forest)


@query("conflict_pairs", f"WITH {PAIRS} SELECT a, b, sim FROM cp")
def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query("conflict_edges", f"WITH {PAIRS} SELECT node, string_agg(other, ',' ORDER BY CAST(other AS VARCHAR)) AS partners FROM (SELECT a AS node, b AS other FROM cp UNION SELECT b, a FROM cp) GROUP BY 1")
def conflict_edges(spark: SparkSession, d: str) -> DataFrame:
    both = G.both_ways(_pairs(spark, d).select("a", "b")).toDF("node", "other")
    return both.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set(F.col("other").cast("string"))), ",").alias("partners"))


@query("conflict_components", f"WITH {PAIRS}, {CC} SELECT node, component FROM cc")
def conflict_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(_pairs(spark, d, forest=True))


@query("conflict_winners", f"WITH {PAIRS}, {CC} SELECT node AS uuid, component, row_number() OVER (PARTITION BY component ORDER BY trust_score DESC, created_at DESC, node) = 1 AS won FROM cc JOIN mem ON uuid = node")
def conflict_winners(spark: SparkSession, d: str) -> DataFrame:
    members = G.components(_pairs(spark, d, forest=True)).withColumnRenamed("node", "uuid").join(records(spark, d).select("uuid", "trust_score", "created_at"), "uuid")
    return G.winners(members).select("uuid", "component", "won")


_NEAR = f"SELECT a.uuid AS uuid, b.uuid AS match, {_SIM} AS sim FROM mem a JOIN mem b ON a.data_type = b.data_type AND a.uuid <> b.uuid WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND b.status = 'active' AND b.superseded_by IS NULL"


@query("dedup_verdict", f"WITH n AS ({_NEAR}), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY sim DESC, match) = 1) SELECT m.uuid, match, sim, CASE WHEN sim >= {DUP} THEN 'duplicate' WHEN sim >= {POSSIBLE} THEN 'possible_duplicate' ELSE 'new' END AS verdict FROM mem m LEFT JOIN b ON b.uuid = m.uuid")
def dedup_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    return G.dedup_verdict(rows, filters.status(rows, "active"), DUP, POSSIBLE)


@query("contradiction_verdict", f"""WITH n AS (SELECT a.uuid AS uuid, b.uuid AS match, {_SIM} AS sim, {_J} AS j FROM mem a JOIN mem b ON a.data_type = b.data_type AND a.uuid <> b.uuid
 WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL AND b.status = 'active' AND b.superseded_by IS NULL AND {_SIM} >= -0.5 AND {_SIM} < {DUP} AND {_GUARD})
SELECT uuid, match, sim FROM n WHERE j IS NULL OR (j >= 0 AND j < 1) QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY sim DESC, match) = 1""")
def contradiction_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    return G.contradictions(rows, filters.status(rows, "active"), -0.5, DUP, 0.0)


@query("echo_shield", f"SELECT a.uuid, max({_SIM}) AS sim, max({_SIM}) >= 0.3 AS echo FROM mem a, mem b WHERE b.uuid % 100 = 0 AND a.uuid <> b.uuid AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL GROUP BY 1")
def echo_shield(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).where("embedding is not null")
    return G.echoes(rows, rows.where("uuid % 100 = 0"), 0.3)


@query("dup_edges", f"SELECT a.uuid AS a, b.uuid AS b, {_SIM} AS sim FROM mem a JOIN mem b ON a.data_type = b.data_type AND a.uuid < b.uuid AND a.source = b.source WHERE a.{LIVE.replace('superseded_by', 'a.superseded_by')} AND b.{LIVE.replace('superseded_by', 'b.superseded_by')} AND NOT a.protected AND NOT b.protected AND a.priority < 2 AND b.priority < 2 AND {_SIM} >= {COS}")
def dup_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.duplicate_edges(filters.status(records(spark, d), "active"), COS).select("a", "b", "sim")


@query("dup_seed_neighbours", f"""WITH e AS (SELECT a.uuid AS a, b.uuid AS b, {_SIM} AS sim FROM mem a JOIN mem b ON a.data_type = b.data_type AND a.uuid <> b.uuid AND a.source = b.source WHERE a.{LIVE.replace('superseded_by', 'a.superseded_by')} AND b.{LIVE.replace('superseded_by', 'b.superseded_by')} AND NOT a.protected AND NOT b.protected AND a.priority < 2 AND b.priority < 2 AND {_SIM} >= {COS})
SELECT a AS seed, b AS uuid, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rn FROM e QUALIFY rn <= 10""")
def dup_seed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = G.duplicate_edges(filters.status(records(spark, d), "active"), COS, 10)
    both = G.both_ways(e.select("a", "b", "sim")).toDF("seed", "uuid", "sim")
    w = W.partitionBy("seed").orderBy(F.desc("sim"), "uuid")
    return both.withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 10")


@query("dup_groups")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.status(records(spark, d), "active")
    return G.greedy_groups(G.duplicate_edges(rows, 0.2, 10).select("a", "b", "sim"), rows, "source")


@query("graph_health", f"""WITH r AS (SELECT * FROM mem WHERE {LIVE} AND embedding IS NOT NULL), n AS (SELECT a.uuid, max({_SIM}) AS sim FROM r a JOIN r b ON a.data_type = b.data_type AND a.uuid <> b.uuid GROUP BY 1)
SELECT uuid, sim FROM n WHERE sim < 0.25 ORDER BY sim, uuid LIMIT 200""")
def graph_health(spark: SparkSession, d: str) -> DataFrame:
    rows = filters.status(records(spark, d), "active").where("embedding is not null").select("uuid", "data_type", "embedding")
    near = G.nearest(rows)
    return near.where("sim < 0.25").orderBy("sim", "uuid").limit(200)


@query("session_chain", """WITH RECURSIVE p AS (SELECT DISTINCT conv_id AS node, CASE WHEN conv_id % 4 <> 0 THEN conv_id - 1 END AS parent FROM conversations),
c(node, cur, depth) AS (SELECT node, node, 0 FROM p UNION ALL SELECT c.node, p.parent, depth + 1 FROM c JOIN p ON p.node = c.cur WHERE p.parent IS NOT NULL)
SELECT node, arg_max(cur, depth) AS root, max(depth) AS depth FROM c GROUP BY node""", mem=False)
def session_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("node")).distinct()
    return G.chain_roots(rows.withColumn("parent", F.expr("case when node % 4 <> 0 then node - 1 end")))


@query("supersession_heads", "SELECT m.uuid FROM mem m LEFT JOIN mem s ON s.uuid = m.superseded_by WHERE m.status = 'active' AND (m.superseded_by IS NULL OR s.uuid IS NULL OR s.status <> 'active')")
def supersession_heads(spark: SparkSession, d: str) -> DataFrame:
    return G.heads(records(spark, d)).select("uuid")


@query("supersession_release", "SELECT m.uuid FROM mem m LEFT JOIN mem s ON s.uuid = m.superseded_by WHERE m.superseded_by IS NOT NULL AND (s.uuid IS NULL OR s.status <> 'active')")
def supersession_release(spark: SparkSession, d: str) -> DataFrame:
    return G.released(records(spark, d)).select("uuid")


@query("lineage_parents", "SELECT m.uuid AS merged, p.uuid AS parent, p.source FROM (SELECT uuid, unnest([uuid - 1, uuid - 2, uuid + 5000]) AS k FROM mem) m JOIN mem p ON p.uuid = m.k")
def lineage_parents(spark: SparkSession, d: str) -> DataFrame:
    merged = records(spark, d).select("uuid", F.expr("array(uuid - 1, uuid - 2, uuid + 5000) as compacted_from"))
    return G.parents(merged, records(spark, d))


@query("repair_lineage", """WITH p AS (SELECT m.uuid AS merged, p.source, p.created_at FROM (SELECT uuid, unnest([uuid - 1, uuid - 2]) AS k FROM mem) m JOIN mem p ON p.uuid = m.k)
SELECT merged AS uuid, CASE WHEN bool_or(source = 'obsidian') THEN 'obsidian' WHEN bool_or(source NOT IN ('agent', 'consolidated', 'user-stated')) THEN min(source) FILTER (source NOT IN ('agent', 'consolidated', 'user-stated')) ELSE 'consolidated' END AS source, min(created_at) AS first_observed_at FROM p GROUP BY 1""")
def repair_lineage(spark: SparkSession, d: str) -> DataFrame:
    merged = records(spark, d).select("uuid", F.expr("array(uuid - 1, uuid - 2) as compacted_from"))
    return G.repaired(merged, records(spark, d))
