"""A persisted vector index that is searched: inverted lists around centroids (IVF).

Vectors are normalised; k-means of MLlib, by cosine, gives the lists. Parts, each a folder of batches:

* ``lists``: (uuid, collection, v) in folders by list, so a search opens the lists it probes only;
* ``ids``: (uuid, list) of each batch; ``gone``: uuids whose earlier versions no longer count;
* ``centroids``: (list, center, apart) of the base: the centre and the largest angle of the base's members to it.

A search with ``probes`` looks into that many nearest lists of each query. Without, it is exact: the
nearest list gives a first k-th best similarity, and by the triangle inequality of angles no member of a
list can beat it if the list's angle to the query, less its widest member's, is larger; only the lists
that remain are opened.

Batches come in order and once: one that is delivered again changes nothing, which suits foreachBatch.
Vectors without a direction (null, zero, not finite, of another size) aren't indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .commits import Versions

#: Vectors that the centroids are learnt from, at most about, and the number of lists, at most.
TRAINED, MOST_LISTS = 200_000, 4096
PARTS = {"lists": "uuid long, collection string, v array<float>, list int", "ids": "uuid long, list int", "centroids": "list int, center array<double>, apart double"}


def unit(v: Column) -> Column:
    """A vector divided by its norm; null if it has no direction."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    held = F.transform(F.array(v.cast("array<double>")), lambda x: F.struct(x.alias("x"), norm(x).alias("n")))[0]
    scaled = F.transform(F.array(held), lambda h: F.when((h["n"] > 0) & (h["n"] < float("inf")) & ~F.isnan(h["n"]), F.transform(h["x"], lambda y: (y / h["n"]).cast("float"))))[0]
    return F.when(v.isNotNull() & ~F.exists(v, lambda y: y.isNull()), scaled)


class VectorIndex:
    """The index in a folder, of vectors of one model and size."""

    def __init__(self, spark: SparkSession, path: str, size: int):
        self.spark, self.path, self.size, self.commits = spark, path, size, Versions(spark, path, "ids", PARTS["ids"])
        self._centers: tuple[int, np.ndarray, np.ndarray, np.ndarray] | None = None

    def build(self, rows: DataFrame, batch: int = 0, lists: int | None = None, seed: int = 7) -> bool:
        """The base of rows (uuid, collection, embedding): learns the centroids and deals out the rows; False if the batch is there already."""
        if not self.commits.isnew(batch):
            return False
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer

        good = self._good(rows)
        n = good.count()
        lists = max(1, min(lists or math.isqrt(n), MOST_LISTS, n))
        # a sample of the rows, by hash, bounds the training and not what is indexed
        part = F.pmod(F.xxhash64("uuid"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, TRAINED / max(n, 1)))
        train = good.where(part).select(array_to_vector("v").alias("features"))
        if n and lists == 1:
            # k-means takes no single list
            mean = train.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
            centers = np.array([mean / (np.linalg.norm(mean) or 1)])
        elif n:
            model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(train)
            centers = np.array([c / (np.linalg.norm(c) or 1) for c in model.clusterCenters()])
        else:
            centers = np.zeros((0, self.size))
        before = self.commits.batches()
        self._put(good, batch, centers, before)
        apart = self._dealt(good, centers).groupBy("list").agg(F.max("angle").alias("apart"))
        told = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, center array<double>").join(F.broadcast(apart), "list", "left")  # one row a list
        self.commits.write(told.select("list", "center", F.coalesce("apart", F.lit(0.0)).alias("apart")), "centroids", batch)
        self.commits.commit(batch, batch)
        return True

    def write(self, rows: DataFrame, batch: int) -> bool:
        """Adds or replaces vectors by uuid; False if the batch is there already. Uuids are unique within a batch."""
        if not self.commits.isnew(batch):
            return False
        self._put(self._good(rows), batch, self.centers()[0], self.commits.batches(), rows.select("uuid"))
        self.commits.commit(batch)
        return True

    def delete(self, uuids: DataFrame, batch: int) -> bool:
        if not self.commits.isnew(batch):
            return False
        self.commits.replace(uuids, batch, self.commits.batches())
        self.commits.commit(batch)
        return True

    def compact(self, batch: int, lists: int | None = None) -> bool:
        """A new base of what counts, with new centroids; what it replaces is removed."""
        done = self.build(self.rows().select("uuid", "collection", F.col("v").alias("embedding")), batch, lists)
        if done:
            self.commits.sweep()
        return done

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """(uuid, collection, v, list) that count, of all lists or of these: only their folders are read."""
        rows = self.commits.read("lists", PARTS["lists"])
        return self.commits.alive(rows if lists is None else rows.where(F.col("list").isin(*lists))).drop("batch")

    def centers(self) -> tuple[np.ndarray, np.ndarray]:
        """(centres, widest angles), at most MOST_LISTS; a later batch may lie further out, which its ids' angles tell."""
        batches = self.commits.batches()
        if self._centers is None or self._centers[0] != batches[-1]:
            got = sorted(self.commits.read("centroids", PARTS["centroids"], batches[:1]).collect(), key=lambda r: r["list"])
            apart = np.array([r["apart"] for r in got])
            if len(batches) > 1 and got:
                c = np.array([r["center"] for r in got])
                added = self._dealt(self.commits.read("lists", PARTS["lists"], batches[1:]).select("uuid", "collection", "v"), c)
                for r in added.groupBy("list").agg(F.max("angle").alias("apart")).collect():
                    apart[r["list"]] = max(apart[r["list"]], r["apart"])
            self._centers = (batches[-1], np.array([r["center"] for r in got]).reshape(-1, self.size), apart)
        return self._centers[1:]

    def _good(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.size("embedding") == self.size).select("uuid", "collection", unit(F.col("embedding")).alias("v")).where("v is not null")

    def _dealt(self, rows: DataFrame, centers: np.ndarray) -> DataFrame:
        """rows with the nearest list and the angle to its centre."""

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
                if len(pdf):
                    cos = x @ centers.T
                    pdf["list"] = cos.argmax(axis=1).astype("int32")
                    pdf["angle"] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
                    yield pdf

        return rows.mapInPandas(near, "uuid long, collection string, v array<float>, list int, angle double")

    def _put(self, good: DataFrame, batch: int, centers: np.ndarray, before: list[int], touched: DataFrame | None = None) -> None:
        dealt = self._dealt(good, centers).select("uuid", "collection", "v", "list")
        # large lists are split over several tasks, small ones share one
        self.commits.write(dealt.hint("rebalance", "list"), "lists", batch, ("list",))
        self.commits.write(self.commits.batch_rows("lists", PARTS["lists"], batch).select("uuid", "list"), "ids", batch)
        # a vector that has lost its direction takes its earlier version with it
        self.commits.replace(touched if touched is not None else good, batch, before)

    def probed(self, q: list[float], probes: int) -> list[int]:
        """The nearest lists of a query."""
        centers, _ = self.centers()
        return np.argsort(-(centers @ np.array(q, float)), kind="stable")[:probes].tolist()

    def _best(self, q: list[float], lists: list[int], k: int, by: bool) -> DataFrame:
        x = np.array(q, float)
        x = x / (np.linalg.norm(x) or 1)
        dot = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(y)) for y in x]), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
        scored = self.rows(lists).select("uuid", "collection", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)), 6).alias("sim"))
        w = W.partitionBy("collection") if by else W.partitionBy()
        return scored.withColumn("rn", F.row_number().over(w.orderBy(F.desc("sim"), "uuid"))).where(F.col("rn") <= k)

    def nearest(self, q: list[float], k: int, probes: int | None = None, by: bool = False) -> tuple[DataFrame, list[int]]:
        """((uuid, collection, sim, rn), lists opened): the k nearest, or those of each collection with ``by``; exact without ``probes``."""
        centers, apart = self.centers()
        if not len(centers) or len(q) != self.size or not np.linalg.norm(q):
            return self._best(q, [-1], k, by), []
        if probes is not None:
            lists = self.probed(q, probes)
            return self._best(q, lists, k, by), lists
        first = self.probed(q, 1)
        # a collection that has fewer than k there has no bound yet
        worst = self._best(q, first, k, by).groupBy("collection").agg(F.min("sim").alias("s"), F.count("*").alias("n")).collect()
        known = self.spark.read.schema(PARTS["lists"]).parquet(f"{self.path}/lists").select("collection").distinct().count() if by else 1
        full = [r["s"] for r in worst if r["n"] >= k] if by else [min(r["s"] for r in worst)] if sum(r["n"] for r in worst) >= k else []
        bound = min(full) if len(full) >= known else -1.0
        x = np.array(q, float) / np.linalg.norm(q)
        angle = np.arccos(np.clip(centers @ x, -1, 1))
        # similarities are rounded to six places, vectors to single precision
        reach = np.cos(np.maximum(0, angle - apart - 1e-3)) >= bound - 1e-5
        lists = sorted({*first, *np.flatnonzero(reach).tolist()})
        return self._best(q, lists, k, by), lists

    def nearest_all(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, uuid, sim, rn) of queries (query_id, q): the k nearest in each one's nearest lists."""
        centers, _ = self.centers()

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    order = np.argsort(-(np.array(pdf["q"].tolist(), float) @ centers.T), axis=1, kind="stable")[:, :probes]
                    pdf["list"] = [x.astype("int32").tolist() for x in order]
                    yield pdf

        asked = queries.select("query_id", unit(F.col("q")).alias("q")).where("q is not null").mapInPandas(deal, "query_id long, q array<float>, list array<int>")
        both = asked.select("query_id", "q", F.explode("list").alias("list")).join(self.rows(), "list")
        dot = F.aggregate(F.zip_with("v", "q", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, y: s + y)
        scored = both.select("query_id", "uuid", F.round(dot, 6).alias("sim"))
        return scored.withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "uuid"))).where(F.col("rn") <= k)


def rebuild(index: VectorIndex, rows: DataFrame, embed, batch: int) -> bool:
    """Brings the index in line with rows (uuid, collection, embedding, status, superseded_by): vectors that lack, have another size or no direction
    are embedded anew and put in with those that the index lacks, and those of records that no longer live are swept.

    ``embed`` takes rows and returns (uuid, embedding). Two batches, ``batch`` and the next; either may be delivered twice.
    """
    from ..operators.filters import status

    live = status(rows)
    held = index.rows().select("uuid") if index.commits.last() is not None else rows.select("uuid").limit(0)
    wrong = live.where((F.size("embedding") != index.size) | unit(F.col("embedding")).isNull())
    new = wrong.drop("embedding").join(embed(wrong).select("uuid", "embedding"), "uuid").select("uuid", "collection", "embedding")
    lacking = live.join(wrong.select("uuid"), "uuid", "left_anti").join(held, "uuid", "left_anti").select("uuid", "collection", "embedding")
    todo = new.union(lacking)
    done = index.build(todo, batch) if index.commits.last() is None else index.write(todo, batch)
    gone = index.rows().select("uuid").join(live.select("uuid"), "uuid", "left_anti")
    return index.delete(gone, batch + 1) or done
