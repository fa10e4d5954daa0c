"""Summaries: identity by canonical URL, scope by profile, search, batch deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stem import folded, search_terms, search_tokens, stems
from ..functions.text import tokens
from ..sources import postings
from . import retrieval
from .filters import clamp


def in_scope(rows: DataFrame, scope: str, profile: str | None) -> DataFrame:
    """own: rows of the profile, which must be named; all: every row; anything else is refused."""
    if scope == "all":
        return rows
    if scope != "own":
        raise ValueError(f"no profile scope {scope!r}")
    if not profile:
        raise ValueError("scope own needs a profile")
    return rows.where(F.col("profile_name") == profile)


def first_wins(rows: DataFrame, *order: Column) -> DataFrame:
    """One row for each source_url: the first in that order."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("source_url").orderBy(*order))).where("rn = 1").drop("rn")


def upserted(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source_url, page_id, outcome): added, or the existing row's id and already_exists."""
    new = first_wins(incoming, F.col("page_id").asc()).select("source_url", "page_id")
    old = first_wins(store, F.col("page_id").asc()).select("source_url", F.col("page_id").alias("old"))
    both = new.join(old, "source_url", "left")
    return both.select("source_url", F.coalesce("old", "page_id").alias("page_id"), F.when(F.col("old").isNull(), "added").otherwise("already_exists").alias("outcome"))


def page(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page of rows in order, newest first, with the total."""
    top = rows.orderBy(F.desc("created_at"), "page_id").offset(offset).limit(clamp(limit, 20, 200))
    return top.join(F.broadcast(rows.agg(F.count("*").alias("total"))), F.lit(True))  # one row


def batch_delete(rows: DataFrame, asked: DataFrame, profile: str) -> DataFrame:
    """Counts of what deleting the asked ids does: deleted, foreign, missing, repeated."""
    once = asked.groupBy("page_id").agg(F.count("*").alias("n"))
    both = once.join(rows.select("page_id", "profile_name"), "page_id", "left")
    own = F.col("profile_name") == profile
    return both.agg(
        F.count_if(own).alias("deleted"), F.count_if(F.col("profile_name").isNotNull() & ~own).alias("foreign"), F.count_if(F.col("profile_name").isNull()).alias("missing"),
        F.sum(F.col("n") - 1).alias("repeated"),
    )


def deleted(rows: DataFrame, asked: DataFrame, scope: str = "own", profile: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows without the asked ids (page_id) in scope, (page_id, outcome) of each asked id once: deleted, foreign or missing)."""
    mine = in_scope(rows, scope, profile).select("page_id", F.lit(True).alias("_mine"))
    once = asked.select("page_id").where("page_id is not null").distinct()
    both = once.join(rows.select("page_id", F.lit(True).alias("_there")), "page_id", "left").join(mine, "page_id", "left")
    told = both.select("page_id", F.when(F.col("_mine"), "deleted").when(F.col("_there"), "foreign").otherwise("missing").alias("outcome"))
    return rows.join(told.where("outcome = 'deleted'").select("page_id"), "page_id", "left_anti").select(*rows.columns), told


def sync_outcomes(rows: DataFrame, files: DataFrame, scope: str = "own", profile: str | None = None) -> DataFrame:
    """(page_id, outcome) of rows that name a file (summary_path), against the files (path) that are there.

    kept; preserved: the file is gone, but the row has its text; orphaned: neither is left; foreign: another profile's, whose files lie elsewhere.
    """
    checked = in_scope(rows, scope, profile).where("summary_path is not null")
    there = files.select(F.col("path").alias("summary_path"), F.lit(True).alias("_there")).distinct()
    own = F.coalesce(F.col("profile_name") == profile, F.lit(False)) if profile else F.lit(False)
    outcome = F.when(~own, "foreign").when(F.col("_there"), "kept").when(F.coalesce(F.col("full_text"), F.lit("")) != "", "preserved").otherwise("orphaned")
    return checked.join(there, "summary_path", "left").select("page_id", outcome.alias("outcome"))


def synced(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """rows as sync_outcomes() leaves them: orphaned ones go, preserved ones name no file any more."""
    both = rows.join(outcomes, "page_id", "left").where("outcome is null or outcome <> 'orphaned'")
    return both.withColumn("summary_path", F.when(F.coalesce(F.col("outcome") != "preserved", F.lit(True)), F.col("summary_path"))).select(*rows.columns)


def search(rows: DataFrame, terms: list[str], limit: int = 10, by: str = "relevance") -> DataFrame:
    """The summaries that hold a term: score (BM25 over title and full text), snippet; best first, or newest first."""
    docs = rows.select(F.lit("all").alias("profile"), F.col("page_id").alias("uuid"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("keywords"), F.lit("").alias("data_id"),
                       F.col("title").alias("topic"), F.col("full_text").alias("content"))
    found = rows.join(retrieval.bm25(docs, terms).where("matched").select(F.col("uuid").alias("page_id"), F.round("score", 6).alias("score")), "page_id")
    order = (F.desc("created_at"),) if by == "date" else (F.desc("score"),)
    top = found.orderBy(*order, "page_id").limit(clamp(limit, 10, 200))
    return top.withColumn("snippet", snippet(F.col("full_text"), terms))


def indexed(rows: DataFrame) -> DataFrame:
    """Summaries as the inverted index takes them. All are one profile: a term weighs the same for everyone, who sees what is decided by scope."""
    return rows.select(F.lit("all").alias("profile"), F.col("page_id").alias("uuid"), F.col("full_text").alias("content"), F.lit("").alias("summary"),
                       F.array().cast("array<string>").alias("keywords"), F.col("title").alias("topic"), F.lit("").alias("data_id"))


def stemmed_words() -> Column:
    """The terms of a row of indexed(): stems of title and full text."""
    return F.coalesce(search_tokens(F.concat_ws(" ", "topic", "content")), F.array().cast("array<string>"))


def search_stems(rows: DataFrame, index: postings.Postings, query: str, limit: int = 10, by: str = "relevance") -> DataFrame:
    """The summaries among rows that hold an inflected form of a word of the query: score (BM25 over stems), snippet with hits in <b>, no full text.

    Best first, or newest first. A query without words finds nothing; a word counts as often as it is given; accents and case don't matter.
    The index is one of indexed() rows by stemmed_words(). Texts are fetched for what is returned only.
    """
    terms = search_terms(query)
    scores = index.scores(terms).select(F.col("uuid").alias("page_id"), F.round("score", 6).alias("score"))
    order = (F.desc("created_at"),) if by == "date" else (F.desc("score"),)
    top = rows.select("page_id", "created_at").join(scores, "page_id").orderBy(*order, "page_id").limit(clamp(limit, 10, 200)).select("page_id", "score")
    found = rows.join(F.broadcast(top), "page_id")  # at most 200 rows
    return found.withColumn("snippet", marked(F.col("full_text"), terms)).drop("full_text").orderBy(*order, "page_id")


def marked(text: Column, terms: list[str], size: int = 48, before: int = 8) -> Column:
    """So many words of a text as they are written, from shortly before the first one whose stem is a term, these in <b>; dots where it is cut."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\x{300}-\x{36f}]*"), F.lit(0))
    both = F.arrays_zip(words.alias("word"), stems(F.transform(words, folded)).alias("stem"))
    hit = lambda x: x["stem"].isin(*terms) if terms else F.lit(False)
    shown = lambda x: F.when(hit(x), F.concat(F.lit("<b>"), x["word"], F.lit("</b>"))).otherwise(x["word"])

    def cut(w: Column) -> Column:
        first = F.coalesce(F.array_position(F.transform(w, hit), True), F.lit(0))
        start = F.greatest(F.lit(1), first - before).cast("int")
        part = F.array_join(F.transform(F.slice(w, start, F.lit(size)), shown), " ")
        return F.concat(F.when(start > 1, "...").otherwise(""), part, F.when(start + size <= F.size(w), "...").otherwise(""))

    return F.transform(F.array(both), cut)[0]


def snippet(text: Column, terms: list[str], size: int = 48, before: int = 8) -> Column:
    """So many words of a text, from shortly before the first one that is a term (from the start without one)."""
    words = tokens(text)
    # through an array of one, so that a text is split once
    at = lambda w: F.coalesce(F.array_min(F.filter(F.array(*[F.array_position(w, t) for t in terms]), lambda p: p > 0)), F.lit(1))
    return F.transform(F.array(words), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), at(w) - before).cast("int"), F.lit(size)), " "))[0]


def get(rows: DataFrame, page_id: int, scope: str = "own", profile: str | None = None) -> DataFrame:
    return in_scope(rows, scope, profile).where(F.col("page_id") == page_id)


def updated(rows: DataFrame, changes: DataFrame, profile: str) -> DataFrame:
    """rows with the non-null values of changes (page_id, title, full_text) where they belong to the profile."""
    c = changes.select("page_id", F.col("title").alias("_title"), F.col("full_text").alias("_text"))
    both = rows.join(c, "page_id", "left")
    own = F.col("profile_name") == profile
    return both.withColumn("title", F.when(own, F.coalesce("_title", "title")).otherwise(F.col("title"))).withColumn("full_text", F.when(own, F.coalesce("_text", "full_text")).otherwise(F.col("full_text"))).select(*rows.columns)
