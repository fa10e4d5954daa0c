"""A persisted inverted index of the records' words.

Parts, each a folder of batches (see commits):

* ``postings``: (profile, term, held), where held lists (uuid, tf, len) of some records that hold the term, in folders by a hash of
  the term and sorted by term within them, so a query opens the folders of its terms only and Parquet skips what lies between them.
  What a task lists together is bounded (CHUNK), so a frequent term has many rows; fewer rows are shuffled and sorted than there are postings;
* ``records``: (profile, uuid, len) of each record as the batch wrote it;
* ``gone``: (uuid) whose earlier versions no longer count: replaced or deleted by the batch;
* ``stats``: (profile, n, total) records and tokens of each profile after the batch.

A batch reads only ids and lengths of what is stored, never other texts. ``compact`` writes what still counts
as a new base and drops what it replaces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .commits import Versions, folder
from .scratch import checkpoints, spread

BUCKETS = 32
#: Changes with the layout or the way records are derived, so that an index of another layout isn't read.
LAYOUT = 3
#: BM25's constants and the weight of a term that is in more than half of the records.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Profiles up to which a query's statistics are sent to all tasks.
BROADCAST_PROFILES = 10_000
#: Words, postings or records that a task lists at once, at most about.
CHUNK = 1 << 22
BLOCKS = "profile string, term string, held array<struct<uuid:bigint,tf:int,len:int>>"
PARTS = {"postings": f"{BLOCKS}, bucket int", "records": "profile string, uuid long, len int", "gone": "uuid long", "stats": "profile string, n long, total long"}


def record_tokens() -> Column:
    """Tokens of all indexed columns together."""
    return F.concat(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in ("content", "summary")], F.coalesce(tokens(F.array_join("keywords", " ")), F.array().cast("array<string>")), *[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in ("topic", "data_id")])


def _chunks(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.Table]:
    """The rows of batches in chunks of a bounded size, a row more at most."""
    some, n = [], 0
    for b in batches:
        ends = np.cumsum(np.maximum(sizes(b), 1))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(b.num_rows, int(np.searchsorted(ends, before + CHUNK - n)) + 1)
            some.append(b.slice(at, to - at))
            n += int(ends[to - 1]) - before
            at = to
            if n >= CHUNK:
                yield pa.Table.from_batches(some).combine_chunks()
                some, n = [], 0
    if n:
        yield pa.Table.from_batches(some).combine_chunks()


def _lengths(words: pa.Array) -> np.ndarray:
    return words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values, and the values."""
    x = column.dictionary_encode("encode")
    return x.indices.to_numpy(zero_copy_only=False).astype(np.int64), x.dictionary


def _listed(group: np.ndarray, terms: pa.Array, profiles: pa.Array, uuid: np.ndarray, tf: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """BLOCKS of postings in order of their group, term * profiles + profile."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    held = pa.StructArray.from_arrays([pa.array(uuid, "int64"), pa.array(tf, "int32"), pa.array(size, "int32")], ["uuid", "tf", "len"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)), "int32"), held)
    of = group[starts]
    return pa.RecordBatch.from_arrays([profiles.take(pa.array(of % len(profiles))), terms.take(pa.array(of // len(profiles))), lists], ["profile", "term", "held"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BLOCKS of records (profile, uuid, words)."""
    for t in _chunks(batches, lambda b: _lengths(b["words"])):
        words, n = t["words"].combine_chunks(), t.num_rows
        size = _lengths(words)
        key, terms = _coded(words.flatten())
        if len(key):
            profile, profiles = _coded(t["profile"].combine_chunks())
            # in place, as there are many words
            row = np.repeat(np.arange(n, dtype="int32"), size)
            key *= len(profiles)
            key += profile[row]
            key *= n
            key += row
            key.sort()
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            tf, each = np.diff(starts, append=len(key)), key[starts]
            row = each % n
            yield _listed(each // n, terms, profiles, t["uuid"].to_numpy()[row], tf, size[row])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BLOCKS of postings (profile, term, uuid, tf, len)."""
    for t in _chunks(batches, lambda b: np.ones(b.num_rows, np.int64)):
        (term, terms), (profile, profiles) = _coded(t["term"].combine_chunks()), _coded(t["profile"].combine_chunks())
        group = term * len(profiles) + profile
        order = np.argsort(group, kind="stable")
        yield _listed(group[order], terms, profiles, *(t[c].to_numpy()[order] for c in ("uuid", "tf", "len")))


def bucket(term: Column, buckets: int) -> Column:
    """The folder of a term, which the driver can tell as well."""
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


class Postings:
    """The index in a folder; ``words`` gives the terms of a record, an array."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, words: Callable[[], Column] = record_tokens):
        self.spark, self.path, self.buckets, self.words, self.commits = spark, path, buckets, words, Versions(spark, path, "records", PARTS["records"])

    def read(self, part: str, batches: list[int] | None = None) -> DataFrame:
        rows = self.commits.read(part, PARTS[part], batches)
        return rows.select("profile", "term", F.inline("held"), "bucket", "batch") if part == "postings" else rows

    def _store(self, blocks: DataFrame, batch: int) -> None:
        """Writes BLOCKS; folders with a frequent term are split over several tasks, small ones share one."""
        each = blocks.withColumn("bucket", bucket(F.col("term"), self.buckets))
        self.commits.write(each.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "postings", batch, ("bucket",))

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Adds records or replaces those of the same uuid; False if the batch is there already. Uuids are unique within a batch."""
        if not self.commits.isnew(batch):
            return False
        before = self.commits.batches()
        columns = ("profile", "uuid", "content", "summary", "keywords", "topic", "data_id")
        split = spread(rows.select(*columns)).select("profile", "uuid", self.words().alias("words"))
        self._store(split.mapInArrow(_split, BLOCKS), batch)
        # a record without words has no postings but counts; lengths are read back, texts aren't split again
        lengths = self.commits.batch_rows("postings", PARTS["postings"], batch).select(F.inline("held")).select("uuid", "len").distinct()
        self.commits.write(rows.select("profile", "uuid").join(lengths, "uuid", "left").select("profile", "uuid", F.coalesce("len", F.lit(0)).alias("len")), "records", batch)
        self._close(batch, before, self.commits.batch_rows("records", PARTS["records"], batch))
        return True

    def delete(self, uuids: DataFrame, batch: int) -> bool:
        """Takes out the records of these uuids; False if the batch is there already."""
        if not self.commits.isnew(batch):
            return False
        none = self.spark.createDataFrame([], PARTS["records"])
        self._close(batch, self.commits.batches(), none, uuids.select("uuid"))
        return True

    def _close(self, batch: int, before: list[int], new: DataFrame, also: DataFrame | None = None) -> None:
        """Writes what the batch takes out and the statistics after it, and commits."""
        gone = self.commits.replace(new if also is None else also, batch, before)
        sums = lambda df, sign: df.groupBy("profile").agg((sign * F.count("*")).alias("n"), (sign * F.sum("len")).alias("total"))
        was = self.commits.living(before).join(gone, "uuid", "left_semi")
        stats = self.read("stats", before[-1:]).select("profile", "n", "total").union(sums(new, 1)).union(sums(was, -1))
        self.commits.write(stats.groupBy("profile").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0"), "stats", batch)
        self.commits.commit(batch)

    def postings(self, terms: list[str] | None = None, profiles: list[str] | None = None) -> DataFrame:
        """(profile, term, uuid, tf, len) that count, of all terms or of these: only their folders are read."""
        rows = self.read("postings")
        if terms is not None:
            places = {zlib.crc32(t.encode()) % self.buckets for t in terms}
            rows = rows.where(F.col("bucket").isin(*places) & F.col("term").isin(*terms)) if terms else rows.limit(0)
        if profiles is not None:
            rows = rows.where(F.col("profile").isin(*profiles))
        return self.commits.alive(rows).select("profile", "term", "uuid", "tf", "len")

    def statistics(self) -> DataFrame:
        """(profile, n, mean): records and their mean length."""
        return self.read("stats", self.commits.batches()[-1:]).select("profile", "n", (F.col("total") / F.col("n")).alias("mean"))

    def scores(self, terms: list[str], profiles: list[str] | None = None) -> DataFrame:
        """(profile, uuid, score, matched): BM25 of the records that hold a term, terms counted as often as they are given."""
        distinct = list(dict.fromkeys(terms))
        held = self.postings(distinct, profiles)
        stats = self.statistics()
        if profiles is not None:
            stats = stats.where(F.col("profile").isin(*profiles))
        n, nt = F.col("n"), F.col("n_docs")
        times = F.element_at(F.create_map(*[x for t in distinct for x in (F.lit(t), F.lit(float(terms.count(t))))]), F.col("term")) if distinct else F.lit(0.0)
        weight = times * F.greatest(F.log((n - nt + 0.5) / (nt + 0.5)), F.lit(LEAST_IDF)) * (K1 + 1)
        weights = held.groupBy("profile", "term").agg(F.count("*").alias("n_docs")).join(stats, "profile").select("profile", "term", "mean", weight.alias("w"))
        # as many rows as the query has terms, for each profile
        if (len(profiles) if profiles is not None else stats.count()) <= BROADCAST_PROFILES:
            weights = F.broadcast(weights)
        damped = K1 * (1 - B + B * F.col("len") / F.col("mean"))
        each = held.join(weights, ["profile", "term"]).select("profile", "uuid", (F.col("w") * F.col("tf") / (F.col("tf") + damped)).alias("s"))
        return each.groupBy("profile", "uuid").agg(F.round(F.sum("s"), 9).alias("score")).withColumn("matched", F.lit(True))

    def lexicon(self) -> DataFrame:
        """(profile, term, n_docs, occurrences) of every term."""
        return self.postings().groupBy("profile", "term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("occurrences"))

    def compact(self, batch: int) -> bool:
        """Writes what counts as a new base, commits it and removes what it replaces; False if the batch is there already."""
        if not self.commits.isnew(batch):
            return False
        names = lambda part: [c.split()[0] for c in PARTS[part].split(", ")]
        live = self.commits.alive(self.read("postings")).select("profile", "term", "uuid", "tf", "len")
        self._store(live.mapInArrow(_gathered, BLOCKS), batch)
        self.commits.write(self.commits.living().select(*names("records")), "records", batch)
        self.commits.write(self.spark.createDataFrame([], PARTS["gone"]), "gone", batch)
        self.commits.write(self.read("stats", self.commits.batches()[-1:]).select(*names("stats")), "stats", batch)
        self.commits.commit(batch, batch)
        self.commits.sweep()
        return True


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the files below some paths: names, sizes, times."""
    told = []
    for path in paths:
        where, fs = folder(spark, path)
        files = fs.listFiles(where, True)
        while files.hasNext():
            s = files.next()
            told.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()[:24]


def of_tables(rows: DataFrame, sf_dir: str, tables: tuple[str, ...] = ("documents", "embeddings"), words: Callable[[], Column] = record_tokens, kind: str = "postings") -> Postings:
    """The index of rows that derive from these tables, kept in the shared folder: built when none is there for just these files and this kind."""
    spark = rows.sparkSession
    out = Postings(spark, f"{checkpoints(spark)}/tessella-{kind}-{LAYOUT}-{fingerprint(spark, *(f'{sf_dir}/{t}.parquet' for t in tables))}", words=words)
    if out.commits.last() is None:
        out.write(rows, 0)
    return out
