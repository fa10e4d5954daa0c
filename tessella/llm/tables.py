"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset (local tests) one is made."""
    path = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT} to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        path = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, *, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there and a lost executor costs no earlier stage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within are deleted at the end, but for those given to the function that it yields."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _scopes.append([])
    try:
        yield keep
    finally:
        for df in _scopes.pop():
            if not any(df is k for k in kept):
                drop(df)
            elif _scopes:
                _scopes[-1].append(df)


def drop(df: DataFrame | None) -> None:
    """Deletes a table made by store() that no later plan reads."""
    path = getattr(df, "_tessella_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Actions within send at most ``rows`` rows (or fewer, if the session says so) to a Python worker at once.

    Spark's 10,000 whole texts are held several times over: by the JVM in buffers of powers of two and by the worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def renamed(stored: DataFrame, *names: str) -> DataFrame:
    """A stored table with other column names; it remains one that can be kept or dropped."""
    out = stored.toDF(*names)
    out._tessella_path = stored._tessella_path
    for scope in _scopes:
        scope[:] = [out if x is stored else x for x in scope]
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of plans that are no longer referenced.

    The cleaner learns of them only when the JVM collects garbage. Without this, the files of every
    round of an iterative operator stay on the executors' disks until the job ends.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns with exactly these names; others may differ from them in case only."""
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string."""
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
