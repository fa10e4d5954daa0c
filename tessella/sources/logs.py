"""Append-only logs (history, extraction ledger, traces), backups and vector indexes as partitioned Parquet."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Commits

def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the folders in a folder, by name."""
    where, fs = _folder(spark, path)
    if not fs.exists(where):
        return []
    return sorted((s.getPath().getName(), fs.getContentSummary(s.getPath()).getLength()) for s in fs.listStatus(where) if s.isDirectory())


def _remove(spark: SparkSession, path: str) -> None:
    where, fs = _folder(spark, path)
    fs.delete(where, True)


def append(entries: DataFrame, path: str, at: str = "ts") -> None:
    """Appends entries, partitioned by the day of their time."""
    entries.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class Log:
    """A log in a folder, written in batches that count once (see commits), each in folders by the day of its entries' time.

    A batch that is delivered again changes nothing, so foreachBatch and repeated tasks may write here. Entries without a time are kept under no day.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, at: str = "ts"):
        self.schema, self.at, self.commits = schema, at, Commits(spark, path)

    def write(self, entries: DataFrame, batch: int) -> bool:
        """Adds a batch of entries (columns of the schema; others are left out); False if it is there already."""
        if not self.commits.isnew(batch):
            return False
        names = [c.strip().split()[0] for c in self.schema.split(", ")]
        self.commits.write(entries.select(*names, F.to_date(self.at).alias("day")), "entries", batch, ("day",))
        self.commits.commit(batch)
        return True

    def read(self) -> DataFrame:
        """The entries with their batch and day; a filter on day opens those folders only."""
        return self.commits.read("entries", f"{self.schema}, day date")

    def recent(self, column: str, part: str = "", days: int = 7, limit: int = 50) -> DataFrame:
        """The newest entries whose column holds a text, whatever the case, of the last days before the newest entry; 1 to 500 of them."""
        rows = self.read()
        since = rows.agg((F.max(self.at) - F.make_dt_interval(F.lit(days))).alias("_since"))
        young = rows.join(F.broadcast(since), F.col(self.at) >= F.col("_since")).drop("_since")  # one row
        held = F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(part.lower()))
        return young.where(held).orderBy(F.desc(self.at), column).limit(max(1, min(limit, 500)))

    def prune(self, first_day: str) -> list[str]:
        """Removes the folders of days before first_day (YYYY-MM-DD); the batches still count as delivered."""
        spark, gone = self.commits.spark, []
        for batch, _ in _children(spark, posixpath.join(self.commits.path, "entries")):
            for name, _ in _children(spark, posixpath.join(self.commits.path, "entries", batch)):
                if name.startswith("day=") and not name.startswith("day=__") and name[4:] < first_day:
                    _remove(spark, posixpath.join(self.commits.path, "entries", batch, name))
                    gone.append(f"{batch}/{name}")
        return gone


#: What a retrieve leaves in its log of traces.
TRACE = "ts timestamp_ntz, profile string, query string, uuids array<bigint>, n long, low_relevance boolean"


def trace(found: DataFrame, query: str, profile: str, at: Column) -> DataFrame:
    """One row of TRACE for a query's results (uuid, rank, bm25), also where nothing was found."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("rank", "uuid"))), lambda x: x["uuid"])  # a top-k
    return found.agg(order.alias("uuids"), F.count("*").alias("n"), (F.coalesce(F.max("bm25"), F.lit(0.0)) == 0).alias("low_relevance")).select(
        at.alias("ts"), F.lit(profile).alias("profile"), F.lit(query).alias("query"), "uuids", "n", "low_relevance"
    )


def history(before: DataFrame, after: DataFrame, now: Column, columns: tuple[str, ...] = ("status", "content", "trust_score", "superseded_by")) -> DataFrame:
    """(uuid, action, changed, ts): what a change set did to each record: added, removed, or updated with the columns that differ."""
    b, a = (x.select("uuid", F.struct(*columns).alias(n)) for x, n in ((before, "b"), (after, "a")))
    both = b.join(a, "uuid", "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    action = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("updated")
    told = both.select("uuid", action.alias("action"), F.when(action == "updated", changed).otherwise(F.array().cast("array<string>")).alias("changed"), now.alias("ts"))
    return told.where((F.col("action") != "updated") | (F.size("changed") > 0))


def rotate(spark: SparkSession, path: str, most_bytes: int) -> list[str]:
    """Removes the oldest days beyond that many bytes; the newest day always stays."""
    days = [(name, size) for name, size in _children(spark, path) if name.startswith("day=")]
    total, gone = sum(size for _, size in days), []
    for name, size in days[:-1]:
        if total <= most_bytes:
            break
        _remove(spark, posixpath.join(path, name))
        total -= size
        gone.append(name)
    return gone


def prune(spark: SparkSession, path: str, first_day: str) -> list[str]:
    """Removes the days before first_day (YYYY-MM-DD)."""
    gone = [name for name, _ in _children(spark, path) if name.startswith("day=") and name[4:] < first_day]
    for name in gone:
        _remove(spark, posixpath.join(path, name))
    return gone


def backup(rows: DataFrame, root: str, name: str, keep: int = 7) -> str:
    """Writes rows to root/name (a plain name, so nothing outside root) and keeps the newest ``keep`` backups by name."""
    if not name or name != posixpath.basename(name) or name.startswith("."):
        raise ValueError(f"{name!r} is no plain name")
    path = posixpath.join(root, name)
    rows.write.partitionBy("profile").parquet(path)
    spark = rows.sparkSession
    for old, _ in _children(spark, root)[:-keep]:
        _remove(spark, posixpath.join(root, old))
    return path


def index_name(model: Column | str, size: Column) -> Column:
    """A vector index's name: vectors of different models or sizes are never compared."""
    model = F.lit(model) if isinstance(model, str) else model
    return F.concat(F.regexp_replace(F.lower(model), "[^a-z0-9]+", "_"), F.lit("_"), size.cast("string"))


def write_index(rows: DataFrame, path: str, model: str) -> None:
    """(uuid, profile, data_type, embedding) of rows that have a vector, one folder for each model and size."""
    named = rows.where("embedding is not null").select("uuid", "profile", "data_type", "embedding", index_name(model, F.size("embedding")).alias("index"))
    named.write.mode("append").partitionBy("index").parquet(path)


def read_index(spark: SparkSession, path: str, model: str, size: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("index") == index_name(model, F.lit(size)))
