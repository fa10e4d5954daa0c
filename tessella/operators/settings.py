"""Settings and taxonomy as tables: requests are replayed in order, each with its outcome, and what holds after them all.

A key's (a name's) requests are looked at in the order of ``seq``, by windows that carry one value along; seq is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .coerce import NO, YES

# Kinds of settings, and bounds of those that have some.
KINDS = {
    "max_layer": "int", "layer0_top_k": "int", "prefetch_limit": "int", "low_trust_archive_days": "int",
    "dedup_threshold": "number", "dedup_warning_threshold": "number", "min_bm25_threshold": "number", "prefetch_min_score": "number", "layer3_timeout_seconds": "number",
    "trust_user_stated": "bool", "confident_entity_keywords": "bool", "enrich_llm": "bool", "auto_extract": "bool", "auto_extract_per_turn": "bool", "dedup_exact_scan": "bool",
    "query_expand": "bool", "tracing": "bool", "seed_overview": "bool",
    "scoring": "object", "collections": "object", "cleanup": "object",
}
BOUNDS = {"max_layer": (0, 4), "layer0_top_k": (1, 200), "prefetch_limit": (0, 20), "dedup_threshold": (0, 1), "dedup_warning_threshold": (0, 1), "min_bm25_threshold": (0, 1)}
TAXONOMY_KINDS = ("data_type", "data_id")
TAXONOMY_NAME = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,63}$"


def setting_problem(key: Column, value: Column) -> Column:
    """Why a value, as text, can't be a key's setting; null if it can. Keys of no fixed kind take anything but null."""
    text = F.trim(value)
    number = text.try_cast("double")
    fits = {
        "int": text.rlike("^[+-]?[0-9]{1,18}$"), "number": number.isNotNull() & ~F.isnan(number), "bool": F.lower(text).isin(*(w for w in (*YES, *NO) if w)),
        "object": F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False)),
    }
    out = F.when(key.isNull() | (F.trim(key) == ""), "a setting needs a key").when(value.isNull(), "a setting needs a value")
    for kind, ok in fits.items():
        out = out.when(key.isin(*(k for k, is_kind in KINDS.items() if is_kind == kind)) & ~F.coalesce(ok, F.lit(False)), f"not of kind {kind}")
    for name, (low, high) in BOUNDS.items():
        out = out.when((key == name) & ~number.between(low, high), f"not from {low} to {high}")
    return out


def config_changes(requests: DataFrame, layers: DataFrame) -> DataFrame:
    """(seq, key, status, value) of requests (seq, action: set or delete, key, value) over layers (key, layer: env or file, value; one row each).

    A set is updated, or error with the reason as value. A delete is deleted, with the environment's value if that holds again;
    not_a_runtime_override if only environment or file have the key; else not_found. A file's value is gone once the key was set, as a
    set replaces it. Any other action is an error.
    """
    beneath = layers.groupBy("key").agg(F.max(F.when(F.col("layer") == "env", F.col("value"))).alias("_env"), F.max(F.when(F.col("layer") == "file", F.col("value"))).alias("_file"))
    rows = requests.join(beneath, "key", "left").withColumn("_problem", F.when(F.col("action") == "set", setting_problem(F.col("key"), F.col("value"))))
    sets, deletes = (F.col("action") == "set") & F.col("_problem").isNull(), F.col("action") == "delete"
    earlier = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(sets, True).when(deletes, False), ignorenulls=True).over(earlier)
    was_set = F.coalesce(F.max(sets).over(earlier), F.lit(False))
    rows = rows.withColumn("_over", F.coalesce(last, F.lit(False))).withColumn("_was", was_set)
    other = F.col("_env").isNotNull() | (F.col("_file").isNotNull() & ~F.col("_was"))
    status = (
        F.when(sets, "updated").when(F.col("action") == "set", "error").when(~deletes | F.col("action").isNull(), "error")
        .when(F.col("_over"), "deleted").when(other, "not_a_runtime_override").otherwise("not_found")
    )
    value = F.when(sets, F.col("value")).when(F.col("action") == "set", F.col("_problem")).when(~deletes | F.col("action").isNull(), "no such action").when(F.col("_over"), F.col("_env"))
    return rows.select("seq", "key", status.alias("status"), value.alias("value"))


def config_now(requests: DataFrame, layers: DataFrame) -> DataFrame:
    """(key, value, layer) that hold after all requests: what was set (runtime), else the environment's, else the file's if the key was never set."""
    done = config_changes(requests, layers).where("status in ('updated', 'deleted')")
    final = done.groupBy("key").agg(F.max_by(F.struct("status", "value"), "seq").alias("s"))
    beneath = layers.groupBy("key").agg(F.max(F.when(F.col("layer") == "env", F.col("value"))).alias("env"), F.max(F.when(F.col("layer") == "file", F.col("value"))).alias("file"))
    both = final.join(beneath, "key", "full")
    on = F.coalesce(F.col("s.status") == "updated", F.lit(False))
    layer = F.when(on, "runtime").when(F.col("env").isNotNull(), "env").when(F.col("s").isNull() & F.col("file").isNotNull(), "file")
    value = F.when(layer == "runtime", F.col("s.value")).when(layer == "env", F.col("env")).otherwise(F.col("file"))
    return both.select("key", value.alias("value"), layer.alias("layer")).where("layer is not null")


def _taxonomy(requests: DataFrame) -> DataFrame:
    """Each request for each kind it means, with whether it is fit."""
    known = F.col("kind").isin(*TAXONOMY_KINDS)
    registers = F.col("action") == "register"
    fit = F.when(registers, known & F.col("name").rlike(TAXONOMY_NAME)).when(F.col("action") == "unregister", (F.col("kind").isNull() | known) & F.col("name").isNotNull())
    rows = requests.withColumn("_fit", F.coalesce(fit, F.lit(False)))
    each = F.when(F.col("kind").isNull(), F.array(*map(F.lit, TAXONOMY_KINDS))).otherwise(F.array("kind"))
    return rows.withColumn("kind", F.explode(each)).withColumn("_on", F.when(F.col("_fit"), F.coalesce(registers, F.lit(False))))


def taxonomy_changes(requests: DataFrame) -> DataFrame:
    """(seq, name, status) of requests (seq, action: register or unregister, name, kind, collection, description).

    registered (anew or replaced), unregistered, not_found, or error: an unknown kind or action, or a name that isn't 1 to 64 letters, digits
    and _ . : - with a letter or digit in front (which unregister doesn't ask for). Unregister without a kind means all kinds of the name.
    """
    earlier = W.partitionBy("name", "kind").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = _taxonomy(requests).withColumn("_there", F.coalesce(F.last("_on", ignorenulls=True).over(earlier), F.lit(False)))
    told = rows.groupBy("seq").agg(F.first("name").alias("name"), F.bool_or("_there").alias("there"), F.bool_and("_fit").alias("fit"), F.max("action").alias("action"))
    status = F.when(~F.col("fit"), "error").when(F.col("action") == "register", "registered").when(F.col("there"), "unregistered").otherwise("not_found")
    return told.select("seq", "name", status.alias("status"))


def taxonomy_now(requests: DataFrame, default_collection: str = "memories") -> DataFrame:
    """(name, kind, collection, description) registered after all requests; a data_type without a collection has the default one."""
    last = _taxonomy(requests).where("_fit").groupBy("name", "kind").agg(F.max_by(F.struct("_on", "collection", "description"), "seq").alias("s")).where("s._on")
    collection = F.when(F.col("kind") == "data_type", F.coalesce("s.collection", F.lit(default_collection))).otherwise(F.col("s.collection"))
    return last.select("name", "kind", collection.alias("collection"), F.col("s.description").alias("description"))
