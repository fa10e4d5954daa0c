"""Predicates and ordered listings over records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import temporal_bounds


def require_text(**named: str | None) -> None:
    """A filter that isn't a string is an error, never an empty answer."""
    for name, value in named.items():
        if value is not None and not isinstance(value, str):
            raise TypeError(f"{name} must be a string, not {type(value).__name__}")


def clamp(limit: int | None, default: int, ceiling: int) -> int:
    return max(1, min(ceiling, int(default if limit is None else limit)))


def status(rows: DataFrame, wanted: str = "active", heads_only: bool = True) -> DataFrame:
    """active: not superseded (unless heads_only is off); all: every row; deleted; anything else narrows to active."""
    require_text(status=wanted)
    if wanted == "all":
        return rows
    if wanted == "deleted":
        return rows.where("status = 'deleted'")
    live = rows.where("status = 'active'")
    return live.where("superseded_by is null") if heads_only else live


def stripped(rows: DataFrame) -> DataFrame:
    """rows as they are answered: without vectors and full texts of summaries."""
    return rows.drop("embedding", "full_text")


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(F.col("ttl").isNull() | (F.col("ttl") > now))


def temporal(rows: DataFrame, query: str, now: datetime) -> DataFrame:
    """Rows created within the query's temporal phrase; all rows without one."""
    bounds = temporal_bounds(query, now)
    if bounds is None:
        return rows
    a, b = (F.lit(str(x)).cast("timestamp_ntz") for x in bounds)
    return rows.where((F.col("created_at") >= a) & (F.col("created_at") <= b))


def equal(rows: DataFrame, **named: str | None) -> DataFrame:
    """Equality on each column that is given; data_id is compared in lower case."""
    require_text(**named)
    for name, value in named.items():
        if value is not None:
            rows = rows.where(F.col(name) == (value.lower() if name == "data_id" else value))
    return rows


def by_trust(rows: DataFrame, k: int) -> DataFrame:
    """The k most trusted live records of each profile, with distances spread over 0.1..0.5 by position."""
    w = W.partitionBy("profile")
    top = status(rows).withColumn("rn", F.row_number().over(w.orderBy(F.desc("trust_score"), "uuid"))).where(F.col("rn") <= k)
    n = F.count("*").over(w)
    distance = F.lit(0.1) + F.lit(0.4) * (F.col("rn") - 1) / F.greatest(n - 1, F.lit(1))
    return top.select("uuid", "profile", "trust_score", F.round(distance, 6).alias("distance"))


def recent_traces(rows: DataFrame, needle: str, limit: int, days: int = 7) -> DataFrame:
    """Newest first, of the last days before the newest, whose type holds the needle."""
    newest = rows.agg((F.max("ts") - F.make_dt_interval(F.lit(days))).alias("since"))
    kept = rows.join(F.broadcast(newest), F.col("ts") >= F.col("since")).where(F.instr(F.lower("event_type"), needle.lower()) > 0)  # one row
    return kept.orderBy(F.desc("ts"), F.desc("event_id")).limit(clamp(limit, 50, 500)).drop("since")


def delete_dry_run(rows: DataFrame, content_like: str | None = None, most: int = 100, **equals: str | None) -> DataFrame:
    """What a bulk delete would do: counts, whether it is refused, five ids."""
    if content_like is None and not any(equals.values()):
        raise ValueError("a bulk delete needs a filter")
    require_text(content_like=content_like, **equals)
    hit = rows.where("status = 'active'")
    for name, value in equals.items():
        hit = hit if value is None else hit.where(F.col(name) == value)
    hit = hit if content_like is None else hit.where(F.col("content").ilike(content_like))
    n = F.count_if(~F.col("protected"))
    five = hit.where("not protected").orderBy("uuid").limit(5).agg(F.array_join(F.array_sort(F.collect_list("uuid")).cast("array<string>"), ",").alias("sample"))
    totals = hit.agg(n.alias("would_delete"), F.count_if("protected").alias("skipped"), (n > most).alias("refused"))
    return totals.withColumn("one", F.lit(1)).join(five.withColumn("one", F.lit(1)), "one").drop("one")


def missing(rows: DataFrame) -> DataFrame:
    return rows.where("keywords is null or size(keywords) = 0 or embedding is null or topic is null or topic = ''")


def browse(rows: DataFrame, sort: str = "created_at", limit: int | None = None) -> DataFrame:
    by = {"created_at": (), "priority": (F.desc("priority"),), "trust": (F.desc("trust_score"),)}[sort]
    return rows.orderBy(*by, F.desc("created_at"), "uuid").limit(clamp(limit, 20, 500))
