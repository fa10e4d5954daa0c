"""Batches of a stored structure: which are committed, and from which one on they count.

A batch is a folder ``<part>/batch=<number>`` of each part of the structure. It counts once its commit
file is there, which is made last; so a batch that broke off is written again and one that is
delivered twice is left alone. A commit names the base, the first batch that readers need.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, path: str):
    """(path, file system) as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    where, fs = folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, fs = folder(spark, path)
    fs.delete(where, True)


class Commits:
    """The committed batches of the structure in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> list[tuple[int, int]]:
        """(batch, base) of each commit, oldest first."""
        return [tuple(map(int, n.split("-"))) for n in names(self.spark, posixpath.join(self.path, "commits")) if n[:1].isdigit()]

    def batches(self) -> list[int]:
        """The batches that readers need."""
        log = self.log()
        base = log[-1][1] if log else 0
        return [b for b, _ in log if b >= base]

    def last(self) -> int | None:
        log = self.log()
        return log[-1][0] if log else None

    def isnew(self, batch: int) -> bool:
        """Whether a batch is still to be written; batches must come in order."""
        log = [b for b, _ in self.log()]
        if batch in log:
            return False
        if log and batch < log[-1]:
            raise ValueError(f"batch {batch} comes after batch {log[-1]}")
        return True

    def commit(self, batch: int, base: int | None = None) -> None:
        log = self.log()
        base = base if base is not None else log[-1][1] if log else batch
        where, fs = folder(self.spark, posixpath.join(self.path, "commits", f"{batch:012d}-{base:012d}"))
        fs.createNewFile(where)

    def write(self, rows: DataFrame, part: str, batch: int, by: tuple[str, ...] = ()) -> None:
        out = rows.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(posixpath.join(self.path, part, f"batch={batch}"))

    def read(self, part: str, schema: str, batches: list[int] | None = None) -> DataFrame:
        """The rows of a part with their batch, of the batches that count."""
        wanted = self.batches() if batches is None else batches
        path = posixpath.join(self.path, part)
        where, fs = folder(self.spark, path)
        if not wanted or not fs.exists(where):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch").isin(*wanted))

    def whole(self, part: str, batch: int) -> bool:
        """Whether a part of a batch is written to its end, committed or not."""
        where, fs = folder(self.spark, posixpath.join(self.path, part, f"batch={batch}", "_SUCCESS"))
        return fs.exists(where)

    def sweep(self) -> list[str]:
        """Removes the folders of batches that no reader needs; returns them."""
        wanted, gone = set(self.batches()), []
        for part in names(self.spark, self.path):
            for name in names(self.spark, posixpath.join(self.path, part)) if part != "commits" else []:
                if name.startswith("batch=") and int(name[6:]) not in wanted:
                    remove(self.spark, posixpath.join(self.path, part, name))
                    gone.append(f"{part}/{name}")
        return gone


class Versions(Commits):
    """Batches of rows with a uuid, of which the newest version counts.

    ``ids`` is the part that has each batch's uuids; ``gone`` has the uuids whose earlier versions a batch replaces or deletes.
    """

    def __init__(self, spark: SparkSession, path: str, ids: str, schema: str):
        super().__init__(spark, path)
        self.ids, self.schema = ids, schema

    def alive(self, rows: DataFrame, batches: list[int] | None = None) -> DataFrame:
        """rows (uuid, batch) whose record no later batch has replaced or deleted."""
        batches = self.batches() if batches is None else batches
        if len(batches) < 2:
            return rows
        later = self.read("gone", "uuid long", batches[1:]).groupBy("uuid").agg(F.max("batch").alias("through"))
        return rows.join(later, "uuid", "left").where("through is null or batch >= through").drop("through")

    def living(self, batches: list[int] | None = None) -> DataFrame:
        """The ids part's rows that count."""
        batches = self.batches() if batches is None else batches
        return self.alive(self.read(self.ids, self.schema, batches), batches)

    def replace(self, touched: DataFrame, batch: int, before: list[int]) -> DataFrame:
        """Writes and returns which of these uuids count before the batch."""
        self.write(self.living(before).join(touched.select("uuid").distinct(), "uuid", "left_semi").select("uuid"), "gone", batch)
        return self.spark.read.schema("uuid long").parquet(posixpath.join(self.path, "gone", f"batch={batch}"))

    def batch_rows(self, part: str, schema: str, batch: int) -> DataFrame:
        """A part of one batch, committed or not."""
        return self.spark.read.schema(schema).parquet(posixpath.join(self.path, part, f"batch={batch}"))
