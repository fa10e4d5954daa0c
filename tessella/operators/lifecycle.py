"""Lifecycle passes: pure functions from a table to a new table or a change set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import age_days, age_seconds

# How much of the decay rate applies by priority.
DECAY_BY_PRIORITY = {0: 1.0, 1: 0.5, 2: 0.2}
OFTEN_USED, OFTEN_USED_FACTOR = 10, 0.3


def decayed(rows: DataFrame, now: Column, min_age: int = 30, max_age: int = 365, rate: float = 0.1, least: float = 0.1) -> DataFrame:
    """(uuid, trust_score, decayed) of active, unprotected, old enough records with trust up to 0.9."""
    kept = rows.where("status = 'active' and not protected and trust_score <= 0.9").where(age_days(F.col("created_at"), now) >= min_age)
    factor = F.lit(0.0)
    for priority, m in DECAY_BY_PRIORITY.items():
        factor = F.when(F.col("priority") == priority, m).otherwise(factor)
    factor = factor * F.when(F.col("reference_count") > OFTEN_USED, OFTEN_USED_FACTOR).otherwise(1.0)
    share = F.least(age_days(F.col("created_at"), now) / float(max_age), F.lit(1.0))
    new = F.greatest(F.lit(least), F.col("trust_score") * (1 - rate * factor * share))
    return kept.select("uuid", "trust_score", F.round(new, 4).alias("decayed"))


def sleep_expired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where("status = 'active'").where(F.col("ttl") <= now).select("uuid", F.lit("ttl").alias("reason"))


def sleep_duplicates(rows: DataFrame, now: Column, grace_hours: float = 24.0, low: float = 0.2) -> DataFrame:
    """Low-trust records beyond the best one of their (data_type, data_id)."""
    own = rows.where("status = 'active' and not protected")
    # the best of each of a few dozen groups, by partial maxima; a group may hold a large part of the rows
    best = own.groupBy("data_type", "data_id").agg(F.max(F.struct("trust_score", "priority", (-F.col("uuid")).alias("u"))).alias("b"))
    best = best.select("data_type", "data_id", (-F.col("b.u")).alias("_best"))
    found = own.where((F.col("trust_score") < low) & (age_seconds(F.col("created_at"), now) / 3600.0 >= grace_hours)).select("uuid", "data_type", "data_id")
    held = found.alias("f").join(best.alias("b"), F.col("f.data_type").eqNullSafe(F.col("b.data_type")) & F.col("f.data_id").eqNullSafe(F.col("b.data_id")))
    return held.where("uuid <> _best").select("uuid", F.lit("low_trust_duplicate").alias("reason"))


def sleep_old(rows: DataFrame, now: Column, days: int = 365, low: float = 0.3) -> DataFrame:
    kept = rows.where("status = 'active' and not protected and priority < 2").where(F.col("trust_score") < low)
    return kept.where(age_days(F.col("created_at"), now) > days).select("uuid", F.lit("low_trust_old").alias("reason"))


def purge_survivors(rows: DataFrame, now: Column, deleted_hours: float = 24.0, archived_hours: float = 168.0) -> DataFrame:
    """What is left when deleted and archived records of that age are gone."""
    for hours in (deleted_hours, archived_hours):
        if hours < 0:
            raise ValueError("an age can't be negative")
    age = age_seconds(F.col("updated_at"), now) / 3600.0
    gone = ((F.col("status") == "deleted") & (age >= deleted_hours)) | ((F.col("status") == "archived") & (age >= archived_hours))
    return rows.where(~gone)


def updated(rows: DataFrame, changes: DataFrame, columns: tuple[str, ...], now: Column) -> DataFrame:
    """rows with non-null values of changes (uuid, columns); user-stated text that is edited loses its standing."""
    c = changes.select("uuid", *[F.col(x).alias(f"new_{x}") for x in columns])
    both = rows.join(c.withColumn("hit", F.lit(True)), "uuid", "left")
    out = both
    for x in columns:
        out = out.withColumn(x, F.coalesce(f"new_{x}", x))
    edited = F.col("new_content").isNotNull() & (F.col("source") == "user-stated") if "content" in columns else F.lit(False)
    out = out.withColumn("source", F.when(edited, "agent").otherwise(F.col("source"))).withColumn("updated_at", F.when(F.col("hit"), now).otherwise(F.col("updated_at")))
    return out.drop("hit", *[f"new_{x}" for x in columns])


def deleted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with those ids marked deleted, and what they superseded released."""
    marked = rows.join(ids.select("uuid", F.lit(True).alias("hit")), "uuid", "left").withColumn("status", F.when(F.col("hit"), "deleted").otherwise(F.col("status"))).drop("hit")
    gone = ids.select(F.col("uuid").alias("superseded_by"), F.lit(True).alias("free"))
    return marked.join(gone, "superseded_by", "left").withColumn("superseded_by", F.when(F.col("free"), None).otherwise(F.col("superseded_by"))).drop("free")


def feedback(rows: DataFrame, votes: DataFrame, step: float = 0.1) -> DataFrame:
    """(uuid, trust_score) after helpful and unhelpful votes (uuid, helpful), clamped and rounded."""
    sums = votes.groupBy("uuid").agg(F.sum(F.when(F.col("helpful"), 1).otherwise(-1)).alias("n"))
    return rows.join(sums, "uuid").select("uuid", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trust_score") + step * F.col("n"))), 4).alias("trust_score"))


def unmarked(rows: DataFrame, marker: str) -> DataFrame:
    """Unprotected active records whose content starts with a marker."""
    return rows.where("status = 'active' and not protected").where(F.startswith("content", F.lit(marker)))


def merged_fields(members: DataFrame, boost: float = 0.05) -> DataFrame:
    """One row for each grp of members (grp, pos, ...): modes with the first-seen value on ties, maxima, minima, unions."""

    def mode(column: str) -> DataFrame:
        n = members.where(F.col(column).isNotNull()).groupBy("grp", column).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
        return n.groupBy("grp").agg(F.max_by(column, F.struct("n", (-F.col("pos")).alias("p"))).alias(column))

    all_ttl = F.count("ttl") == F.count("*")
    out = members.groupBy("grp").agg(
        F.round(F.least(F.lit(1.0), F.max("trust_score") + boost), 4).alias("trust_score"), F.min("created_at").alias("first_observed_at"), F.max("sensitivity").alias("sensitivity"),
        F.bool_or("protected").alias("protected"), F.when(all_ttl, F.max("ttl")).alias("ttl"), F.count("*").alias("n"),
    )
    for column in ("data_type", "data_id"):
        out = out.join(mode(column), "grp", "left")
    return out


def imported(existing: DataFrame, incoming: DataFrame, mode: str, trusted: tuple[str, ...]) -> DataFrame:
    """(uuid, content, source) after an import; modes skip_existing, overwrite, new_uuid (ids that collide get new ones above all others)."""
    claimed = F.when(F.col("source").isin(*trusted), "import").otherwise(F.col("source"))
    new = incoming.select("uuid", "content", claimed.alias("source"))
    old = existing.select("uuid", "content", "source")
    if mode == "skip_existing":
        return old.union(new.join(old.select("uuid"), "uuid", "left_anti"))
    if mode == "overwrite":
        return old.join(new.select("uuid"), "uuid", "left_anti").union(new)
    if mode == "new_uuid":
        top = old.agg(F.max("uuid").alias("top")).unionAll(new.agg(F.max("uuid"))).agg(F.max("top").alias("top"))
        hit = new.join(old.select("uuid"), "uuid", "left_semi").join(F.broadcast(top), F.lit(True))  # one row
        return old.union(new.join(old.select("uuid"), "uuid", "left_anti")).union(hit.select((F.col("top") + 1 + F.col("uuid")).alias("uuid"), "content", "source"))
    raise ValueError(f"no import mode {mode!r}")
