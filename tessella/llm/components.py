"""Connected components by label propagation with pointer jumping, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    A round takes the smallest label of the neighbours, then the label of that label, so a
    path of n nodes needs about log n rounds. Rounds end at written tables; the loop stops
    when the sum of labels does.
    """
    both = tables.store(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = tables.store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    total = None
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        # both directions are there, so every node hears its neighbours
        near = labels.union(heard).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = tables.store(near.join(up, "label", "left").select("node", F.least("label", "above").alias("label")), "labels")
        now = new.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        tables.drop(labels)
        labels = new
        if now == total:
            break
        total = now
    tables.drop(both)
    return tables.renamed(labels, "node", "component")
