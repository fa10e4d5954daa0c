"""Quality metrics of retrieval, dedup and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_mrr(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(n, recall, mrr) of results (q, uuid, rank from 1) against truth (q, uuid): a query counts as found if any expected record is in the first k."""
    return of_first_hits(truth.join(results, ["q", "uuid"], "left").groupBy("q").agg(F.min("rank").alias("rank")), k)


def of_first_hits(hit: DataFrame, k: int) -> DataFrame:
    """recall_mrr() of each query's first expected rank, null if there is none."""
    return hit.agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr")
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Counts, precision and recall of rows (said, truth: booleans)."""
    tp, fp = F.count_if(F.expr("said and truth")), F.count_if(F.expr("said and not truth"))
    fn, tn = F.count_if(F.expr("not said and truth")), F.count_if(F.expr("not said and not truth"))
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"))


def pair_quality(rows: DataFrame) -> DataFrame:
    """Pair precision and recall, and purity, of rows (grp, label): n(n-1)/2 pairs from counts, no pair is made."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cell = rows.groupBy("grp", "label").agg(F.count("*").alias("n"))
    both = cell.agg(pairs("n").alias("both")).withColumn("one", F.lit(1))
    grp = cell.groupBy("grp").agg(F.sum("n").alias("g"), F.max("n").alias("top")).agg(pairs("g").alias("made"), F.sum("top").alias("top"), F.sum("g").alias("all")).withColumn("one", F.lit(1))
    label = cell.groupBy("label").agg(F.sum("n").alias("l")).agg(pairs("l").alias("true")).withColumn("one", F.lit(1))
    out = both.join(grp, "one").join(label, "one")
    return out.select(F.round(F.try_divide("both", "made"), 6).alias("precision"), F.round(F.try_divide("both", "true"), 6).alias("recall"), F.round(F.try_divide("top", "all"), 6).alias("purity"))


def gate(new: DataFrame, old: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(metric, old, new, passed): a metric may fall by the tolerance, relatively."""
    return old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "metric").withColumn("passed", F.col("new") >= F.col("old") * (1 - tolerance))


def headroom(results: DataFrame, truth: DataFrame, forbidden: DataFrame, k: int) -> DataFrame:
    """(n, headroom, forbidden): queries whose best expected record is found, but only beyond k; forbidden records among the first k."""
    best = truth.join(results, ["q", "uuid"], "left").groupBy("q").agg(F.min("rank").alias("rank"))
    bad = results.where(F.col("rank") <= k).join(forbidden.select("q", "uuid").distinct(), ["q", "uuid"]).agg(F.count("*").alias("forbidden"), F.lit(1).alias("one"))
    out = best.agg(F.count("*").alias("n"), F.count_if(F.col("rank") > k).alias("headroom"), F.lit(1).alias("one"))
    return out.join(F.broadcast(bad), "one").drop("one")  # one row


def latency(times: DataFrame) -> DataFrame:
    """(n, p50, longest) of seconds."""
    return times.agg(F.count("*").alias("n"), F.round(F.percentile("seconds", 0.5), 6).alias("p50"), F.round(F.max("seconds"), 6).alias("longest"))
