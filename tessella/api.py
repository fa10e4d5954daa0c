"""One object for a record store: retrieval, listings, changes, maintenance, export.

Reads return DataFrames; changes return the new table (or the change set) and never
write. ``write`` puts a table down as a new snapshot, partitioned by profile.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import aggregates, enrich, filters, graph, lifecycle, passes, retrieval
from .sources import exchange, logs
from .sources.postings import K1, LEAST_IDF, B, Postings


class Store:
    """Records (columns of sources.records.RECORD) seen from one profile, at one time."""

    def __init__(self, rows: DataFrame, profile: str, now: datetime):
        self.rows, self.profile, self.clock = rows, profile, now
        self.own = rows.where(F.col("profile") == profile)

    @property
    def now(self) -> Column:
        return F.lit(str(self.clock)).cast("timestamp_ntz")

    # reads
    def retrieve(
        self, query: str, vector: list[float] | None = None, depth: int = 2, limit: int = 5, status: str = "active", across: bool = False,
        scores: DataFrame | None = None, gap: enrich.Model | None = None, **equals: str | None,
    ) -> DataFrame:
        """The best records, without their vectors: depth 0 and 1 in pool order, 2 fused, 3 reranked by scores (uuid, model_score),
        4 as 2 with annotations (unresolved_conflict among them), and with what the model ``gap`` says is missing on the first row.

        Without a vector only the lexical arm is used; without a term that means something nothing is found.
        """
        filters.require_text(query=query, status=status)
        limit = filters.clamp(limit, 5, 200)
        rows = self.rows if across else self.own
        terms = re.findall(r"[^\W_]+", query.lower())
        if not any(len(t) > 1 and t not in T.LOW_CONTENT for t in terms):
            return rows.limit(0).withColumn("fusion", F.lit(0.0))
        bm = retrieval.bm25(rows, terms)
        words = retrieval.lexical_topk(rows, bm, max(3 * limit, 15))
        if vector is None:
            near = retrieval.vector_scores(rows, rows.sparkSession.createDataFrame([([0.0],)], "q array<float>")).limit(0)
        else:
            near = retrieval.vector_topk(rows, rows.sparkSession.createDataFrame([(list(map(float, vector)),)], "q array<float>"), 30 * (3 if across else 1))
        pool = retrieval.pool_across(near, words) if across else retrieval.pool(near, words)
        kept = filters.temporal(filters.equal(rows, **equals), query, self.clock)
        found = retrieval.hydrated(pool, kept, bm, self.now, status)
        found = filters.stripped(found)
        if depth <= 1:
            return found.orderBy("rank").limit(limit)
        out = retrieval.fused(found, terms, self.now)
        if depth == 3 and scores is not None:
            return retrieval.reranked(out, scores).orderBy("position").limit(limit)
        top = out.orderBy(F.desc("fusion"), "rank").limit(limit)
        if depth < 4:
            return top
        # contradictions among the 20 best, returned or not
        best = out.orderBy(F.desc("fusion"), "rank").limit(20)
        whole = filters.status(rows).join(F.broadcast(best.select("uuid")), "uuid", "left_semi")
        told = retrieval.conflict_noted(retrieval.annotated(top), best, graph.conflict_pairs(whole, 0.85, 0.7))
        if gap is None:
            return told
        # one prompt for the whole answer, on its first row
        texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", T.fence(F.col("content"), F.col("source")).alias("text")))), lambda x: x["text"]), "\n")
        prompt = told.agg(F.concat(F.lit(f"What does this answer to {query!r} leave out?\n"), texts).alias("prompt"))
        asked = enrich.ask(prompt, "prompt", "gap", gap).select("gap")
        first = F.row_number().over(Window.partitionBy().orderBy("rank")) == 1  # at most limit rows
        return told.join(F.broadcast(asked), F.lit(True)).withColumn("gap", F.when(first, F.col("gap")))

    def left_behind(self, query: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(a row for the log of traces, the new table) after an explicit retrieve: its results of the own profile count as read once more."""
        own = found.where(F.col("profile") == self.profile).select("uuid").distinct()
        return logs.trace(found, query, self.profile, self.now), passes.bumped(self.rows, own)

    def fallback(self, query: str, vector: list[float] | None = None, profile: str | None = None, limit: int = 30) -> DataFrame:
        """(uuid, distance, mode): what is found while the index is away, by vectors (own profile only), else by words, else by trust."""
        own = profile is None or profile == self.profile
        rows = self.own if own else self.rows.where(F.col("profile") == profile)
        q = rows.sparkSession.createDataFrame([(None if vector is None else list(map(float, vector)),)], "q array<float>")
        return retrieval.degraded(rows, q, retrieval.bm25(rows, re.findall(r"[^\W_]+", query.lower())), filters.clamp(limit, 30, 200), own)

    def peek(self, query: str, vector: list[float] | None = None, depth: int = 1) -> DataFrame:
        return self.retrieve(query, vector, depth, 30)

    def discover(self, vector: list[float], limit: int = 10, least: float = 0.0) -> DataFrame:
        """Metadata of other profiles' nearest records."""
        q = self.rows.sparkSession.createDataFrame([(list(map(float, vector)),)], "q array<float>")
        near = retrieval.vector_scores(self.rows.where(F.col("profile") != self.profile), q).where(F.col("sim") >= least)
        return near.orderBy(F.desc("sim"), "uuid").limit(filters.clamp(limit, 10, 50)).select("uuid", "profile", "data_type", "data_id", "topic", "source", "trust_score", "created_at", "sim")

    def list(self, sort: str = "created_at", limit: int | None = None, **equals: str | None) -> DataFrame:
        return filters.browse(filters.equal(filters.status(self.own), **equals), sort, limit)

    def count(self) -> DataFrame:
        return filters.status(self.own).agg(F.count("*").alias("n"))

    def stats(self) -> DataFrame:
        return aggregates.usage(filters.status(self.own))

    def overview(self) -> DataFrame:
        return aggregates.overview(filters.status(self.own), 15)

    def sync_check(self, index: DataFrame, size: int) -> DataFrame:
        return aggregates.sync(filters.status(self.own), index, size)

    def graph_health(self, threshold: float = 0.5, limit: int = 200) -> DataFrame:
        near = graph.nearest(filters.status(self.own).where("embedding is not null").select("uuid", "data_type", "embedding"))
        return near.where(F.col("sim") < threshold).orderBy("sim", "uuid").limit(filters.clamp(limit, 200, 5000))

    # changes
    def add(self, incoming: DataFrame, duplicate: float = 0.97, possible: float = 0.95, force: bool = False, contradiction: float = 0.85) -> tuple[DataFrame, DataFrame]:
        """(new table, verdicts): of a batch, what is usable and not yet in the store; the smallest uuid of equal contents goes
        first. What a row contradicts is superseded by it; rows without a type are classified."""
        # by a digest, so that copies are counted before they move
        digest = F.sha2(F.coalesce("content", F.lit("")), 256)
        firsts = incoming.groupBy(digest.alias("_d")).agg(F.min("uuid").alias("_first"))
        once = incoming.withColumn("_d", digest).join(firsts, "_d").where("uuid = _first").drop("_d", "_first")
        if force:
            verdicts = once.select("uuid", F.lit("added").alias("verdict"), F.lit(None).cast("long").alias("match"), F.lit(None).cast("long").alias("contradicts"))
        else:
            verdicts = passes.verdicts(once, self.own, duplicate, possible, contradiction)
        return passes.added(self.rows, once, verdicts), verdicts

    def update(self, changes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return lifecycle.updated(self.rows, changes, columns, self.now)

    def delete(self, ids: DataFrame) -> DataFrame:
        return lifecycle.deleted(self.rows, ids)

    def delete_many(self, most: int = 100, execute: bool = False, content_like: str | None = None, **equals: str | None) -> DataFrame:
        """The dry run's counts, or the new table if execute is set and no more than ``most`` records are hit."""
        counts = filters.delete_dry_run(self.own, content_like, most, **equals)
        if not execute:
            return counts
        if counts.first()["refused"]:
            raise ValueError(f"more than {most} records")
        hit = self.own.where("status = 'active' and not protected")
        for name, value in equals.items():
            hit = hit if value is None else hit.where(F.col(name) == value)
        return self.delete((hit if content_like is None else hit.where(F.col("content").ilike(content_like))).select("uuid"))

    def feedback(self, votes: DataFrame) -> DataFrame:
        return lifecycle.feedback(self.rows, votes)

    def sleep(self, limit: int = 100) -> DataFrame:
        """(uuid, reason) of what to archive, at most limit of each reason."""
        passes = (lifecycle.sleep_expired(self.own, self.now), lifecycle.sleep_duplicates(self.own, self.now), lifecycle.sleep_old(self.own, self.now))
        out = [p.orderBy("uuid").limit(limit) for p in passes]
        return out[0].union(out[1]).union(out[2]).groupBy("uuid").agg(F.min("reason").alias("reason"))

    def decay(self, **settings: float) -> DataFrame:
        return lifecycle.decayed(self.own, self.now, **settings)

    def purge(self, **hours: float) -> DataFrame:
        return passes.purged(self.rows, self.now, **hours)

    def put_to_sleep(self) -> DataFrame:
        """The new table: all that is due is archived, also beyond sleep()'s limit, and what it superseded released."""
        others = self.rows.where(~F.col("profile").eqNullSafe(self.profile))
        return passes.asleep(self.own, self.now).unionByName(others)

    def resolve_conflicts(self, cosine: float = 0.85, jaccard: float = 0.7) -> DataFrame:
        """(uuid, component, won) of records in conflict groups."""
        parts = graph.components(graph.conflict_pairs(filters.status(self.own), cosine, jaccard, forest=True)).withColumnRenamed("node", "uuid")
        return graph.winners(parts.join(self.own.select("uuid", "trust_score", "created_at"), "uuid"))

    def compact(self, least: float = 0.9) -> DataFrame:
        """(grp, uuid) of duplicate groups to merge."""
        live = filters.status(self.own)
        return graph.greedy_groups(graph.duplicate_edges(live, least, 10).select("a", "b", "sim"), live, "source")

    def review(self, model: enrich.Model = enrich.offline, limit: int = 200) -> DataFrame:
        """The oldest records with a model's verdict; untrusted text is fenced."""
        rows = filters.status(self.own).orderBy("created_at", "uuid").limit(limit)
        return enrich.ask(rows.select("uuid", T.fence(F.col("content"), F.col("source")).alias("prompt")), "prompt", "verdict", model)

    # exchange
    def export(self, fmt: str = "json", status: str = "active", **equals: str | None) -> DataFrame:
        rows = filters.equal(filters.status(self.own, status), **equals)
        return {"json": exchange.json_lines, "markdown": exchange.markdown}[fmt](rows)

    def import_records(self, incoming: DataFrame, mode: str = "skip_existing") -> DataFrame:
        """The new table; incoming has all columns of a record, or at least uuid, content and source."""
        if set(self.rows.columns) <= set(incoming.columns):
            return passes.imported(self.rows, incoming, self.now, mode)
        return lifecycle.imported(self.rows, incoming, mode, T.TRUSTED_SOURCES)

    @staticmethod
    def write(rows: DataFrame, path: str) -> None:
        rows.write.partitionBy("profile").parquet(path)


def register(spark: SparkSession) -> None:
    """SQL functions text_tokens, cosine and fence_untrusted, with SQL bodies that Catalyst sees through."""
    spark.sql("create or replace temporary function text_tokens(t string) returns array<string> return regexp_extract_all(lower(t), '[\\\\p{L}\\\\p{N}]+', 0)")
    spark.sql(
        "create or replace temporary function cosine(a array<double>, b array<double>) returns double return "
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"
    )
    spark.sql(
        "create or replace temporary function fence_untrusted(t string, source string) returns string return case when t is null or t = '' or "
        f"source in ({', '.join(repr(s) for s in T.TRUSTED_SOURCES)}) then t else concat('{T.FENCE_OPEN}', replace(replace(t, '{T.FENCE_OPEN}', ''), '{T.FENCE_CLOSE}', ''), '{T.FENCE_CLOSE}') end"
    )


def register_search(spark: SparkSession, rows: DataFrame, index: Postings) -> None:
    """SQL table functions over a store and its inverted index, as temporary functions with SQL bodies:

    search_words(asked, who): (uuid, score), BM25 of a profile's records that hold a word, whatever their status;
    search_near(v, who): (uuid, sim), cosine of a profile's live records whose vectors have the size of v.

    Add ORDER BY and LIMIT for the best ones. Null or blank arguments find nothing. The records are the view tessella_records.
    """
    register(spark)
    rows.createOrReplaceTempView("tessella_records")
    # with their folders, so that only those of the words are opened
    index.commits.alive(index.read("postings")).createOrReplaceTempView("tessella_postings")
    index.statistics().createOrReplaceTempView("tessella_statistics")
    spark.sql(
        f"""create or replace temporary function search_words(asked string, who string) returns table(uuid long, score double) return
        with words as (select term, count(*) as times from (select explode(regexp_extract_all(lower(asked), '[\\\\p{{L}}\\\\p{{N}}]+', 0)) as term) group by term),
        held as (select p.term, p.uuid, p.tf, p.len, w.times from tessella_postings p join words w on p.term = w.term where p.profile = who
            and array_contains(transform(regexp_extract_all(lower(asked), '[\\\\p{{L}}\\\\p{{N}}]+', 0), t -> cast(crc32(cast(t as binary)) % {index.buckets} as int)), p.bucket)),
        weights as (select h.term, first(h.times) * greatest(ln((first(s.n) - count(*) + 0.5D) / (count(*) + 0.5D)), {LEAST_IDF}D) * {K1 + 1}D as w, first(s.mean) as mean
            from held h join tessella_statistics s on s.profile = who group by h.term)
        select h.uuid, round(sum(w.w * h.tf / (h.tf + {K1}D * ({1 - B}D + {B}D * h.len / w.mean))), 9) as score from held h join weights w on h.term = w.term group by h.uuid"""
    )
    spark.sql(
        """create or replace temporary function search_near(v array<double>, who string) returns table(uuid long, sim double) return
        select uuid, round(greatest(-1D, least(1D, coalesce(cosine(cast(embedding as array<double>), v), 0D))), 6) as sim from tessella_records
        where profile = who and status = 'active' and superseded_by is null and size(embedding) = size(v)"""
    )


__all__ = ["Store", "register", "register_search"]
