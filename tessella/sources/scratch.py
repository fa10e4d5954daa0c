"""Intermediate tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables. Only a local master (tests) without one gets one made."""
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT, None) or sc.getCheckpointDir()
    if not path and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT} to a folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tessella-"))
    return path or sc.getCheckpointDir()


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes what several steps read and reads it back: it is worked out once, and a lost executor costs no earlier stage."""
    path = f"{checkpoints(df.sparkSession)}/tessella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores if they come of fewer files than there are cores (so small tables only), else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows
