"""Counts and overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The built-in record types.
TYPES = ("USER-DATA", "ENV-DATA", "SESSION-DATA", "SYSTEM", "CUSTOM", "OBSIDIAN", "CODE")


def overview(rows: DataFrame, limit: int) -> DataFrame:
    """The largest (data_type, data_id) groups with mean trust and their sources."""
    out = rows.groupBy("data_type", "data_id").agg(
        F.count("*").alias("n"), F.round(F.avg("trust_score"), 2).alias("trust"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    )
    return out.orderBy(F.desc("n"), "data_type", "data_id").limit(limit)


def profiles(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    counts = rows.groupBy("profile").agg(F.count_if(F.expr("status = 'active' and superseded_by is null")).alias("active"), F.count_if(F.expr("status = 'deleted'")).alias("deleted"))
    return counts.join(summaries.groupBy("profile").agg(F.count("*").alias("summaries")), "profile", "left").fillna(0, ["summaries"])


def ledger(events: DataFrame, lines: int, runs: int, own: Column) -> DataFrame:
    """Of the last lines of the ledger, the newest own runs, by hook."""
    newest = (F.desc("ts"), F.desc("event_id"))
    last = events.orderBy(*newest).limit(lines).where(own).orderBy(*newest).limit(runs)
    return last.groupBy(F.col("event_type").alias("hook")).agg(F.count("*").alias("runs"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("stored"))


def usage(rows: DataFrame) -> DataFrame:
    n, used = F.count("*"), F.count_if(F.col("reference_count") > 0)
    return rows.agg(n.alias("n"), used.alias("used"), F.when(n == 0, 0.0).otherwise(F.round(100.0 * used / n, 1)).alias("used_pct"), (F.count_if(F.col("embedding").isNull()) == n).alias("degraded"))


def sync(live: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """Store against index: counts of rows, vectors, wrong sizes and index entries without a record."""
    both = live.select("uuid", "embedding", F.lit(True).alias("stored")).join(index.withColumn("indexed", F.lit(True)), "uuid", "full")
    stored = F.col("stored").isNotNull()
    return both.agg(
        F.count_if(stored).alias("stored"), F.count_if(stored & F.col("embedding").isNotNull()).alias("indexed"), F.count_if(stored & F.col("embedding").isNull()).alias("no_vector"),
        F.count_if(F.size("embedding") != F.when(F.col("embedding").isNotNull(), size)).alias("wrong_size"), F.count_if(~stored).alias("orphans"),
    )


def maintenance_due(rows: DataFrame, index: DataFrame, anchor: int, least: int) -> DataFrame:
    """Enough inserts since the anchor; and whether the index drifted by 5 rows or 2 %."""
    n = rows.agg(F.max("doc_id").alias("seq"), F.count("*").alias("n")).withColumn("one", F.lit(1))
    m = index.agg(F.count("*").alias("m")).withColumn("one", F.lit(1))
    return n.join(m, "one").select("seq", (F.col("seq") - anchor >= least).alias("due"), (F.col("n") - F.col("m") >= F.greatest(F.lit(5.0), F.col("n") * 0.02)).alias("rebuild"))


def conversion(rows: DataFrame, used: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("injected"), F.count_if(used).alias("used"), F.round(100.0 * F.count_if(used) / F.count("*"), 1).alias("pct"))


def known_types(registered: DataFrame) -> DataFrame:
    built_in = registered.sparkSession.createDataFrame([(t,) for t in TYPES], "name string")
    return built_in.union(registered.select("name")).distinct()
