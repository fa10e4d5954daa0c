"""Repairs, clamps and checks of incoming fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired_time(text: Column, now: Column) -> Column:
    """The time, or now for what is none or lies ahead."""
    at = text.try_cast("timestamp_ntz")
    return F.when(at.isNull() | (at > now), now).otherwise(at)


def repaired_list(text: Column) -> Column:
    """A JSON list; a bare word is a list of one; anything else is empty."""
    parsed = F.try_parse_json(text)
    as_list = F.from_json(text, "array<string>")
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    bare = (text != "") & ~F.substring(text, 1, 1).isin("[", "{")
    return F.when(F.coalesce(is_list, F.lit(False)), as_list).when(bare, F.array(text)).otherwise(F.array().cast("array<string>"))


def repaired_object(text: Column) -> Column:
    """The JSON object as it is, or {}."""
    is_object = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return F.when(F.coalesce(is_object, F.lit(False)), text).otherwise("{}")


def clamp_trust(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def clamp_level(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), x))


def dashed(hex32: Column) -> Column:
    return F.concat_ws("-", *(F.substring(hex32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def qualified(text: Column) -> tuple[Column, Column]:
    """(TYPE, id) of 'TYPE:id'; the id is lower-cased, null without one."""
    parts = F.split(text, ":")
    return F.get(parts, F.lit(0)), F.lower(F.get(parts, F.lit(1)))


def reject_reason(most_content: int = 50_000, most_keywords: int = 200) -> Column:
    """Why a record can't be stored; null if it can."""
    content = F.coalesce(F.col("content"), F.lit(""))
    return (
        F.when(content == "", "content is empty").when(F.length(content) > most_content, f"content is longer than {most_content}")
        .when(~F.col("data_type").rlike("^[A-Z][A-Z0-9_-]*$"), "data_type is no name").when(F.size("keywords") > most_keywords, "too many keywords")
        .when(~F.col("trust_score").between(0, 1), "trust_score is out of range")
    )


def session_class(messages: Column, tools: Column, tokens: Column, end_reason: Column) -> Column:
    m, t, o = (F.coalesce(c, F.lit(0)) for c in (messages, tools, tokens))
    return (
        F.when((m <= 4) & (t <= 1) & (o <= 2000), "skip").when(F.coalesce(end_reason == "compression", F.lit(False)), "important")
        .when((m >= 10) | (t >= 5) | (o >= 5000), "important").otherwise("medium")
    )


def session_name(session: Column, title: Column) -> Column:
    return F.when(title.isNull(), session.cast("string")).otherwise(F.concat(session.cast("string"), F.lit(" :: "), F.replace(title, F.lit(" :: "), F.lit(" : "))))


# Fixed value: the namespace of ids that imports make of foreign ones.
IMPORT_NAMESPACE = "6f1c2b4e-9a3d-5e7f-8b21-4c6d0e9f3a57"


def is_uuid(text: Column) -> Column:
    """Whether a text is a UUID, of 32 hex digits or dashed."""
    return text.rlike("^([0-9a-f]{32}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a name in a namespace, as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def import_id(text: Column) -> Column:
    """A UUID as 32 digits; any other id by its name in the import namespace."""
    return F.when(is_uuid(text), F.lower(F.replace(text, F.lit("-"), F.lit("")))).otherwise(uuid5(IMPORT_NAMESPACE, text))
