"""Hybrid retrieval: vector and lexical candidates, one pool, filters, BM25, rank fusion.

Each step is a DataFrame; nothing is collected. BM25 scores come of the persisted index
(sources/postings.py), which reads what a query's terms need, or of ``bm25``, which goes
through texts that have no index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.time import recency
from ..functions.vector import cosine
from ..sources.postings import K1, LEAST_IDF, B, record_tokens
from ..sources.scratch import spread, store
from .filters import by_trust, status, unexpired


@dataclass(frozen=True)
class Weights:
    """Weights of the fusion score."""

    bm25: float = 0.30
    trust: float = 0.05
    recency: float = 0.05
    topic: float = 0.05
    keyword: float = 0.05
    pinned: float = 1.5
    rank: int = 60


def matches(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(profile, uuid, len, hits) of every record: how many tokens it has and those that are terms. Written, so that a text is split once."""
    # through an array of one, so that the tokens are worked out once
    one = F.transform(F.array(record_tokens()), lambda t: F.struct(F.size(t).alias("len"), F.filter(t, lambda x: x.isin(*terms) if terms else F.lit(False)).alias("hits")))
    return store(spread(rows.select("profile", "uuid", "content", "summary", "keywords", "topic", "data_id")).select("profile", "uuid", one[0].alias("m")).select("profile", "uuid", "m.len", "m.hits"), "matches")


def statistics(matched: DataFrame, terms: list[str]) -> DataFrame:
    """(profile, n, mean, term, n_docs): records and their mean length in each profile, and how many hold each term."""
    size = matched.groupBy("profile").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    # partial counts first: a term in most records is summed within each task
    held = matched.select("profile", F.explode(F.array_distinct("hits")).alias("term")).groupBy("profile", "term").agg(F.count("*").alias("n_docs"))
    every = size.select("*", F.explode(F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")).alias("term"))
    return every.join(held, ["profile", "term"], "left").fillna(0, ["n_docs"])


def bm25(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(profile, uuid, score, matched): BM25 of every record of every status, terms counted as often as they are given.

    The inverse document frequency of a term in more than half of a profile's records is LEAST_IDF, not negative.
    """
    distinct = list(dict.fromkeys(terms))
    matched = matches(rows, distinct)
    n, nt = F.col("n"), F.col("n_docs")
    times = F.element_at(F.create_map(*[x for t in distinct for x in (F.lit(t), F.lit(float(terms.count(t))))]), F.col("term")) if distinct else F.lit(0.0)
    weight = times * F.greatest(F.log((n - nt + 0.5) / (nt + 0.5)), F.lit(LEAST_IDF)) * (K1 + 1)
    weights = statistics(matched, distinct).groupBy("profile").agg(F.first("mean").alias("mean"), F.map_from_entries(F.collect_list(F.struct("term", weight.alias("w")))).alias("weights"))
    both = matched.join(F.broadcast(weights), "profile", "left")  # one row for each profile, of the query's terms
    damped = K1 * (1 - B + B * F.col("len") / F.col("mean"))
    # a record's few hits, each term once
    each = F.transform(F.array_distinct("hits"), lambda t: F.struct(t.alias("t"), F.size(F.filter("hits", lambda x: x == t)).cast("double").alias("f")))
    score = F.aggregate(each, F.lit(0.0), lambda s, x: s + F.element_at("weights", x["t"]) * x["f"] / (x["f"] + damped))
    return both.select("profile", "uuid", F.round(score, 9).alias("score"), (F.size("hits") > 0).alias("matched"))


def normalised(scores: DataFrame) -> DataFrame:
    """Adds bm25: 0..1 by minimum and maximum over all matches of the profile; 1 if all are equal, 0 without a match."""
    range_ = scores.where("matched").groupBy("profile").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    both = scores.join(F.broadcast(range_), "profile", "left")  # one row for each profile
    value = F.when(~F.col("matched"), 0.0).when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return both.withColumn("bm25", F.round(value, 6)).drop("_lo", "_hi")


def vector_scores(rows: DataFrame, query: DataFrame) -> DataFrame:
    """Live records that have a vector, with sim to the one query vector (column q)."""
    live = status(rows).where("embedding is not null")
    return live.join(F.broadcast(query.select("q")), F.size("embedding") == F.size("q")).withColumn("sim", F.round(cosine(F.col("embedding"), F.col("q")), 6)).drop("q")  # one row


def vector_topk(rows: DataFrame, query: DataFrame, k: int) -> DataFrame:
    return vector_scores(rows, query).orderBy(F.desc("sim"), "uuid").limit(k)


def vector_topk_by(rows: DataFrame, query: DataFrame, k: int, by: str) -> DataFrame:
    """The k nearest of each collection."""
    w = W.partitionBy(by).orderBy(F.desc("sim"), "uuid")
    return vector_scores(rows, query).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def lexical_topk(rows: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """The k best live matches of each profile."""
    live = status(rows).select("profile", "uuid")
    w = W.partitionBy("profile").orderBy(F.desc("score"), "uuid")
    return live.join(scores.where("matched"), ["profile", "uuid"]).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("profile", "uuid", "score", "rn")


def degraded(rows: DataFrame, query: DataFrame, scores: DataFrame, k: int, exact: bool = True, indexed: DataFrame | None = None, breaker: DataFrame | None = None) -> DataFrame:
    """(uuid, distance, mode): candidates by the best way that the data leave open, chosen within one plan.

    vector: the index's hits (uuid, sim), unless the breaker's one row (column open) says that it is open; brute_force: all vectors of the
    query's size (column q of at most one row, which may be null), if ``exact``, as a profile's vectors answer for itself only; lexical: the
    best matches of scores; scan: the most trusted records of each profile. The first that finds anything gives all rows, at most k (scan: k
    for each profile); the last two spread their distances over 0.1..0.5 by place.
    """
    arm = lambda df, i, mode: df.select("uuid", "distance", F.lit(i).alias("arm"), F.lit(mode).alias("mode"))
    near = F.round(1 - F.col("sim"), 6).alias("distance")
    arms = []
    if indexed is not None:
        hits = indexed if breaker is None else indexed.join(F.broadcast(breaker.select("open").limit(1)), ~F.col("open"))  # one row
        arms.append(arm(status(rows).select("uuid").join(hits.select("uuid", "sim"), "uuid").orderBy(F.desc("sim"), "uuid").limit(k).select("uuid", near), 0, "vector"))
    if exact:
        arms.append(arm(vector_topk(rows, query.where("q is not null"), k).select("uuid", near), 1, "brute_force"))
    found = status(rows).select("profile", "uuid").join(scores.where("matched").select("profile", "uuid", "score"), ["profile", "uuid"]).orderBy(F.desc("score"), "uuid").limit(k)
    # at most k rows
    place, n = F.row_number().over(W.orderBy(F.desc("score"), "uuid")), F.count("*").over(W.partitionBy())
    spread_out = F.round(0.1 + 0.4 * (F.col("i") - 1) / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("distance")
    arms.append(arm(found.select("uuid", place.alias("i"), n.alias("n")).select("uuid", spread_out), 2, "lexical"))
    arms.append(arm(by_trust(rows, k), 3, "scan"))
    every = arms[0]
    for a in arms[1:]:
        every = every.union(a)
    # top rows of each way
    return every.withColumn("first", F.min("arm").over(W.partitionBy())).where("arm = first").select("uuid", "distance", "mode")


def pool(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """(uuid, distance): vector hits by 1 - sim; lexical hits that aren't among them follow the worst one."""
    hits = vector.select("uuid", F.round(1 - F.col("sim"), 6).alias("distance"))
    worst = hits.agg(F.coalesce(F.max("distance"), F.lit(0.1)).alias("worst"))
    more = lexical.join(hits, "uuid", "left_anti").withColumn("i", F.row_number().over(W.orderBy("rn", "uuid")))  # at most k rows
    return hits.union(more.join(F.broadcast(worst), F.col("i") > 0).select("uuid", F.round(F.col("worst") + 0.01 * F.col("i"), 6)))


def pool_across(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """(uuid, distance) over profiles: both arms interleaved by position, spread over 0.1..0.5."""
    v = vector.select("uuid", F.row_number().over(W.orderBy(F.desc("sim"), "uuid")).alias("pos"), F.lit(0).alias("arm"))
    x = lexical.select("uuid", F.row_number().over(W.orderBy("rn", "profile", "uuid")).alias("pos"), F.lit(1).alias("arm"))
    first = v.union(x).groupBy("uuid").agg(F.min(F.struct("pos", "arm")).alias("p"))
    place = F.row_number().over(W.orderBy("p", "uuid"))
    n = F.count("*").over(W.partitionBy())
    return first.select("uuid", place.alias("i"), n.alias("n")).select("uuid", F.round(0.1 + 0.4 * (F.col("i") - 1) / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("distance"))


def hydrated(pool: DataFrame, rows: DataFrame, scores: DataFrame, now: Column, wanted: str = "active") -> DataFrame:
    """Layer 1: the pool's records that pass status and time to live, with bm25, in rank order (rank from 0)."""
    kept = unexpired(status(rows, wanted), now).join(F.broadcast(pool), "uuid")  # the pool is a top-k
    kept = kept.join(normalised(scores).select("profile", "uuid", "bm25"), ["profile", "uuid"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    order = W.orderBy(F.when(F.col("priority") >= 3, 0).otherwise(1), "distance", "uuid")
    return kept.withColumn("rank", F.row_number().over(order) - 1)


def at_least_bm25(rows: DataFrame, least: float) -> DataFrame:
    """All rows, or none if the best bm25 is below least."""
    return rows.withColumn("_best", F.max("bm25").over(W.partitionBy())).where(F.col("_best") >= least).drop("_best")


def fused(rows: DataFrame, terms: list[str], now: Column, weights: Weights | None = None, base: str = "rank") -> DataFrame:
    """Layer 2: adds base and fusion; base is the position's reciprocal rank, or the similarity itself."""
    w = weights or Weights()
    words = F.array(*[F.lit(t) for t in dict.fromkeys(terms)]) if terms else F.array().cast("array<string>")
    start = (1.0 + w.rank) / (w.rank + F.col("rank") + 1.0) if base == "rank" else 1 - F.col("distance")
    topic = F.size(F.array_intersect(tokens(F.col("topic")), words)) > 0
    keyword = F.size(F.array_intersect(F.transform("keywords", lambda k: F.lower(k)), words)) > 0
    score = (
        start + w.bm25 * F.col("bm25") + F.when(topic, w.topic).otherwise(0.0) + F.when(keyword, w.keyword).otherwise(0.0)
        + w.trust * F.col("trust_score") + w.recency * recency(F.col("created_at"), now, F.col("priority") >= 3)
    )
    return rows.withColumn("base", F.round(start, 6)).withColumn("fusion", F.round(score * F.when(F.col("priority") >= 3, w.pinned).otherwise(1.0), 6))


def reranked(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored rows first by score, the others in their order; position from 1."""
    both = rows.join(scores, "uuid", "left")
    order = W.orderBy(F.when(F.col("model_score").isNotNull(), 0).otherwise(1), F.desc("model_score"), "rank")
    return both.withColumn("position", F.row_number().over(order))


def annotated(rows: DataFrame) -> DataFrame:
    """Adds low_relevance (no bm25 at all) and the pool's range of fusion to the first row, null elsewhere."""
    w = W.partitionBy()
    first = F.col("rank") == 0
    note = F.concat(F.format_number(F.min("fusion").over(w), 3), F.lit(".."), F.format_number(F.max("fusion").over(w), 3))
    return rows.withColumn("low_relevance", F.when(first, F.max("bm25").over(w) == 0)).withColumn("pool_range", F.when(first, note))


def conflict_noted(top: DataFrame, scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """top with unresolved_conflict: true on its first row (by fusion) if a pair (a, b) of contradicting records is among all that were
    scored (uuid), whether returned or not; null elsewhere."""
    ids = scored.select("uuid")
    met = pairs.join(F.broadcast(ids.toDF("a")), "a", "left_semi").join(F.broadcast(ids.toDF("b")), "b", "left_semi")  # a top-k
    first = F.row_number().over(W.orderBy(F.desc("fusion"), "rank")) == 1
    return top.join(F.broadcast(met.agg((F.count("*") > 0).alias("_any"))), F.lit(True)).withColumn("unresolved_conflict", F.when(first & F.col("_any"), True)).drop("_any")  # one row


def expanded_terms(top: DataFrame, terms: list[str], n: int = 5) -> DataFrame:
    """(term): the query's terms and those of keywords and topics of the n nearest records."""
    near = top.orderBy(F.desc("sim"), "uuid").limit(n)
    more = near.select(F.explode(F.array_union(F.transform("keywords", lambda k: F.lower(k)), tokens(F.col("topic")))).alias("term"))
    own = top.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return own.union(more).distinct()


def alert(rows: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(alert): one line for each conflict (a, b) between results (uuid, rank from 0), by their places from 1; null without one."""
    place = rows.select("uuid", (F.col("rank") + 1).alias("n"))
    met = conflicts.join(place.toDF("a", "i"), "a").join(place.toDF("b", "j"), "b")
    pair = F.struct(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    lines = F.transform(F.sort_array(F.collect_list(pair)), lambda p: F.concat(F.lit("results "), p["i"].cast("string"), F.lit(" and "), p["j"].cast("string"), F.lit(" disagree")))
    return met.agg(F.when(F.count("*") > 0, F.array_join(lines, "\n")).alias("alert"))  # the results are a top-k
