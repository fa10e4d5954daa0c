"""Approximate nearest neighbours (operator 10): NN-descent and greedy graph search.

``build_graph`` keeps for every distinct vector its K best neighbours so far. It starts
from groups of about ``LEAF`` vectors, dealt by a hash and by the leaves of ``TREES``
random-hyperplane trees, which give each vector a rough first list. Then NN-descent: in each round every vector's neighbours
and at most ``REVERSE`` of those that have it as one meet, and any two of them of which one
is new are scored and offered to each other; rounds go on until one improves fewer than
``DELTA`` of the lists' entries. ``search`` walks the graph from each query's own vector and
the ``ENTRIES`` longest ones: the best EF nodes are kept and the best unvisited ones among
them expanded, until none is left.

Nearness is the inner product. While the graph is built, vectors have one more component, so
that all have the same norm and the largest inner product means nearest; that distance is
worked out from unit vectors, norms and differences of the last components, so that neither
the scale of the vectors nor a few very long ones cost precision. Final scores are computed
from the original vectors in double precision. Equal vectors are one node; a node lists its
smallest ids, as many as a result can hold.

The tree's upper levels use planes through a bounded sample (``SAMPLE``), the lower ones, as
many as the number of vectors asks for, seeded directions; leaves that stay large are dealt out
in parts. Every vector is placed; the trees are only a start, and recall comes from the rounds.

Defined cases: null and zero vectors and those with null or non-finite components take
no part, nor do null ids; rows that repeat a vec_id count once (the smallest vector);
shorter vectors are extended with zeros; with fewer than k candidates all are returned;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables, workers

K = 40
REVERSE = 40
TREES = 2
LEAF = 64
SAMPLE = 8192
#: Levels of a tree whose planes go through the sample; its leaves then hold about 16 sampled vectors.
SAMPLED_LEVELS = 9
#: A round that improves fewer than this share of all neighbour lists' entries is the last.
DELTA = 0.004
EF = 160
#: Nodes of a query that are expanded in a step, and the longest vectors that every query starts from.
EXPANDED, ENTRIES = 80, 16
#: Bytes of vectors that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_BYTES = 48 << 20
#: Rows that the local join takes together, and scores it has at a time.
TOGETHER, SCORES = 40_000, 800_000


def _kind(size: int, bits: str) -> np.dtype:
    """A vector as stored: its norm (of the largest), the component that makes all norms equal, and its direction."""
    return np.dtype([("norm", "<f8"), ("pad", "<f8"), ("unit", bits, (size,))])


def nodes(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """((node, norm, vec), (node, vec_id), (node, vec_id), (node, v), size): distinct vectors in stored form, the k
    smallest ids of each, all ids, the vectors as they are, and the most components of one."""
    usable = F.size("v") > 0
    usable &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(usable).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = tables.store(rows, "vectors")
    named = tables.store(rows.groupBy("v").agg(F.min("vec_id").alias("node")), "nodes")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    # the norm in two factors, as squares of very large or small components are out of range
    parts = named.select("node", "v", largest.alias("a")).withColumn("b", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + (x / F.col("a")) * (x / F.col("a")))))
    size, most = (x or 1 for x in named.agg(F.max(F.size("v")), F.max(largest)).first())
    longest = parts.agg(F.max(F.col("a") / F.lit(most) * F.col("b"))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(size, "<f4")
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            out = np.zeros(batch.num_rows, kind)
            for i, v in enumerate(batch.column("v").to_pylist()):
                out["unit"][i, : len(v)] = np.array(v) / a[i] / b[i]
            norm = np.minimum(a / most * b / longest, 1.0)
            out["norm"], out["pad"] = norm, np.sqrt((1 - norm) * (1 + norm))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(norm), pa.array([r.tobytes() for r in out], pa.binary())], ["node", "norm", "vec"])

    base = tables.store(parts.select("node", "v", "a", "b").mapInArrow(run, "node long, norm double, vec binary"), "base")
    several = tables.store(named.join(rows, "v").select("node", "vec_id"), "ids")
    tables.drop(rows)
    members = several.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k).drop("r")
    return base, tables.store(members, "members"), several, named, int(size)


def _rows(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _placed(rows: np.ndarray) -> np.ndarray:
    """Vectors with their last component, all of norm 1: what planes cut."""
    return np.concatenate([rows["unit"].astype(np.float32) * rows["norm"].astype(np.float32)[:, None], rows["pad"].astype(np.float32)[:, None]], 1)


def _planes(sample: np.ndarray, trees: int, depth: int) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each tree and level, (normals, thresholds) of its nodes: medians of random directions."""
    rng = np.random.default_rng(12)
    out = []
    for _ in range(trees):
        at, levels = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            normals, cuts = np.zeros((1 << level, sample.shape[1]), np.float32), np.zeros(1 << level, np.float32)
            for node in range(1 << level):
                own = sample[at == node]
                if len(own) > 1:
                    p, q = rng.choice(len(own), 2, replace=False)
                    normals[node] = own[p] - own[q]
                    cuts[node] = np.median(own @ normals[node])
            at = at * 2 + ((sample * normals[at]).sum(1) > cuts[at])
            levels.append((normals, cuts))
        out.append(levels)
    return out


def _leaves(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for normals, cuts in levels:
        at = at * 2 + ((x * normals[at]).sum(1) > cuts[at])
    return at


_OFFER = "node long, other long, score float, fresh boolean"
_LISTS = "node long, others array<bigint>, scores array<float>, fresh array<boolean>"


def _offers(node: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(score, pa.float32()), pa.array(np.ones(len(node), bool))], ["node", "other", "score", "fresh"])


def first_meetings(base: DataFrame, n: int, size: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(centre, node, fresh): the leaves of the trees, and groups by a hash that connect them, are the first centres."""
    kind = _kind(size, "<f4")
    sample = base.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    x = _placed(np.frombuffer(b"".join(r["vec"] for r in sample), kind))
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    planes = _planes(x, trees, min(depth, SAMPLED_LEVELS))
    # below them, the same directions for all leaves, through the middle of what the sample has of each
    deeper = np.random.default_rng(34).normal(size=(trees, max(0, depth - SAMPLED_LEVELS), size + 1)).astype(np.float32)
    middles = []
    for levels in planes:
        at = _leaves(x, levels)
        sums = np.zeros((1 << len(levels), size + 1), np.float32)
        np.add.at(sums, at, x)
        middles.append(sums / np.maximum(1, np.bincount(at, minlength=len(sums)))[:, None])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _placed(_rows(batch.column("vec"), kind))
            for t, levels in enumerate(planes):
                at = _leaves(own, levels)
                if len(deeper[t]):
                    sides = (own - middles[t][at]) @ deeper[t].T > 0
                    for level in range(sides.shape[1]):
                        at = at * 2 + sides[:, level]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(at), batch.column("node")], ["tree", "leaf", "node"])

    chance = base.select(F.lit(-1).alias("tree"), F.pmod(F.xxhash64("node", F.lit("group")), F.lit(math.ceil(n / leaf))).alias("leaf"), "node")
    placed = tables.store(base.select("node", "vec").mapInArrow(place, "tree int, leaf long, node long").union(chance), "placed")
    # leaves that couldn't be split (many near vectors) are dealt out in parts of about a leaf
    large = placed.groupBy("tree", "leaf").agg(F.count("*").alias("m")).where(F.col("m") > 2 * leaf)
    part = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.coalesce("m", F.lit(1)) / leaf).cast("long"))
    dealt = placed.join(large, ["tree", "leaf"], "left").withColumn("part", part)
    return dealt.select(F.xxhash64("tree", "leaf", "part").alias("centre"), "node", F.lit(True).alias("fresh"))


def _merge(k: int):
    """Puts offers, sorted by node, together: the k best different ones of each node, as lists."""

    def lists(node: np.ndarray, other: np.ndarray, score: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
        # an entry that was there before wins over the same one offered again
        order = np.lexsort((fresh, other, node))
        node, other, score, fresh = node[order], other[order], score[order], fresh[order]
        once = np.r_[True, (node[1:] != node[:-1]) | (other[1:] != other[:-1])]
        node, other, score, fresh = node[once], other[once], score[once], fresh[once]
        order = np.lexsort((other, -score, node))
        node, other, score, fresh = node[order], other[order], score[order], fresh[order]
        heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        rank = np.arange(len(node)) - np.repeat(heads, np.diff(np.r_[heads, len(node)]))
        kept = rank < k
        names = node[heads]
        sizes = np.add.reduceat(kept.astype(np.int64), heads)
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        parts = [pa.ListArray.from_arrays(ends, pa.array(c[kept], kind)) for c, kind in ((other, pa.int64()), (score, pa.float32()), (fresh, pa.bool_()))]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *parts], ["node", "others", "scores", "fresh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "other", "score", "fresh")])
            size += batch.num_rows
            if size > 200_000:
                node, other, score, fresh = (np.concatenate(c) for c in zip(*held))
                # the last node may go on
                cut = int(np.searchsorted(node, node[-1]))
                if cut:
                    yield lists(node[:cut], other[:cut], score[:cut], fresh[:cut])
                node, other, score, fresh = node[cut:], other[cut:], score[cut:], fresh[cut:]
                if len(node) > 8 * k:
                    # one node with very many offers: only its best matter
                    best = np.lexsort((other, -score))[:200_000]
                    node, other, score, fresh = node[best], other[best], score[best], fresh[best]
                held, size = [[node, other, score, fresh]], len(node)
        if held:
            node, other, score, fresh = (np.concatenate(c) for c in zip(*held))
            if len(node):
                yield lists(node, other, score, fresh)

    return run


def _meetings(graph: DataFrame, reverse: int) -> DataFrame:
    """(centre, node, fresh): each node's neighbours and a bounded number of those that have it as one."""
    pairs = graph.select("node", F.explode(F.arrays_zip("others", "fresh")).alias("e")).select("node", F.col("e.others").alias("other"), F.col("e.fresh").alias("fresh"))
    forward = pairs.select(F.col("node").alias("centre"), F.col("other").alias("node"), "fresh")
    back = pairs.select(F.col("other").alias("centre"), "node", "fresh")
    place = F.row_number().over(W.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("centre", "node"), "node"))
    back = back.withColumn("r", place).where(F.col("r") <= reverse).drop("r")
    return forward.union(back).groupBy("centre", "node").agg(F.max("fresh").alias("fresh"))


def _new_meetings(graph: DataFrame, reverse: int) -> DataFrame:
    """Those meetings where somebody is new."""
    mine = graph.where(F.exists("fresh", lambda f: f)).select(F.col("node").alias("centre"))
    theirs = graph.select(F.explode(F.arrays_zip("others", "fresh")).alias("e")).where("e.fresh").select(F.col("e.others").alias("centre"))
    return _meetings(graph, reverse).join(mine.union(theirs).distinct(), "centre", "left_semi")


def _local_join(size: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (centre, node, fresh, vec, worst), sorted by centre: offers between any two nodes of a centre of which one is new."""
    kind = _kind(size, "<f2")

    def scored(x: np.ndarray, at: np.ndarray, there: np.ndarray, fresh: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows at[g, i] of x meet in group g, where there[g, i]: (row, other row, score)."""
        unit, norm, pad = x["unit"][at].astype(np.float32), x["norm"][at], x["pad"][at]
        square = norm * norm
        s = (unit @ unit.transpose(0, 2, 1)) * norm[:, :, None] * norm[:, None, :]
        s -= (square[:, :, None] + square[:, None, :] + (pad[:, :, None] - pad[:, None, :]) ** 2) / 2
        s = s.astype(np.float32)
        ok = s > worst[at][:, :, None]
        ok &= (fresh[at][:, :, None] | fresh[at][:, None, :]) & there[:, :, None] & there[:, None, :]
        ok &= ~np.eye(at.shape[1], dtype=bool)[None]
        g, i, j = np.nonzero(ok)
        return at[g, i], at[g, j], s[g, i, j]

    def offers(table: pa.Table) -> Iterator[pa.RecordBatch]:
        centre, node = table["centre"].to_numpy(), table["node"].to_numpy()
        fresh, worst = table["fresh"].to_numpy(), table["worst"].to_numpy()
        x = _rows(table["vec"], kind)
        heads = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
        sizes = np.diff(np.r_[heads, len(centre)])
        # groups of about the same size together
        order = np.argsort(sizes, kind="stable")
        found = []
        first = 0
        while first < len(order):
            last = first + 1
            while last < len(order) and (last + 1 - first) * int(sizes[order[last]]) ** 2 <= SCORES:
                last += 1
            some = order[first:last]
            steps = np.arange(int(sizes[some[-1]]))
            there = steps[None, :] < sizes[some][:, None]
            found.append(scored(x, np.where(there, heads[some][:, None] + steps[None, :], heads[some][:, None]), there, fresh, worst))
            first = last
        a, b, score = (np.concatenate(c) for c in zip(*found))
        to, other = node[a], node[b]
        # the same pair meets at several centres; of what is offered to a node only the best k matter
        order = np.lexsort((other, -score, to))
        to, other, score = to[order], other[order], score[order]
        once = np.r_[True, (to[1:] != to[:-1]) | (other[1:] != other[:-1])] if len(to) else np.zeros(0, bool)
        to, other, score = to[once], other[once], score[once]
        heads = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
        kept = np.arange(len(to)) - np.repeat(heads, np.diff(np.r_[heads, len(to)])) < k
        yield _offers(to[kept], other[kept], score[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= TOGETHER:
                table = pa.Table.from_batches(held)
                centre = table["centre"].to_numpy()
                # the last centre may go on
                cut = int(np.searchsorted(centre, centre[-1]))
                if cut:
                    yield from offers(table.slice(0, cut))
                rest = table.slice(cut)
                held, count = rest.to_batches(), rest.num_rows
        if held:
            yield from offers(pa.Table.from_batches(held))
        workers.trim()

    return run


def _halves(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Directions as 16-bit floats: enough to find candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("vec"), _kind(size, "<f4")).astype(_kind(size, "<f2"))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in x], pa.binary())], ["node", "vec"])

    return run


def build_graph(base: DataFrame, n: int, size: int, k: int = K, reverse: int = REVERSE, trees: int = TREES, leaf: int = LEAF, rounds: int | None = None) -> DataFrame:
    """(node, others, scores, fresh): up to k near nodes of each node, best first; ``rounds`` is for comparisons only."""
    spark = base.sparkSession
    small = tables.store(base.select("node", "vec").mapInArrow(_halves(size), "node long, vec binary"), "halves")
    few = n * (2 * size + 64) <= BROADCAST_BYTES
    none = F.lit(float("-inf")).cast("float")

    def joined(meetings: DataFrame, graph: DataFrame | None) -> DataFrame:
        known = small.withColumn("worst", none)
        if graph is not None:
            worst = F.when(F.size("scores") >= k, F.element_at("scores", -1)).otherwise(none)
            known = small.join(graph.select("node", worst.alias("worst")), "node", "left").select("node", "vec", F.coalesce("worst", none).alias("worst"))
        rows = meetings.join(F.broadcast(known) if few else known, "node").select("centre", "node", "fresh", "vec", "worst")
        return rows.repartition("centre").sortWithinPartitions("centre").mapInArrow(_local_join(size, k), _OFFER)

    def merged(offers: DataFrame) -> DataFrame:
        return tables.store(offers.repartition("node").sortWithinPartitions("node").mapInArrow(_merge(k), _LISTS), "graph")

    graph = merged(joined(first_meetings(base, n, size, trees, leaf), None))
    done = 0
    while rounds is None or done < rounds:
        old = graph.select("node", F.explode(F.arrays_zip("others", "scores")).alias("e")).select("node", F.col("e.others").alias("other"), F.col("e.scores").alias("score"), F.lit(False).alias("fresh"))
        new = merged(old.union(joined(_new_meetings(graph, reverse), graph)))
        changed = new.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
        tables.drop(graph)
        graph = new
        done += 1
        tables.release(spark)
        if changed < DELTA * n * k:
            break
    tables.drop(small)
    return graph


def _scores(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(query, node, score) of rows (query, node, qvec, vec)."""
    kind = _kind(size, "<f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, x = _rows(batch.column("qvec"), kind), _rows(batch.column("vec"), kind)
                score = np.einsum("ij,ij->i", q["unit"], x["unit"], dtype=np.float64) * q["norm"] * x["norm"]
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("node"), pa.array(score)], ["query", "node", "score"])

    return run


def _ways(graph: DataFrame, reverse: int) -> DataFrame:
    """(node, others): each node's neighbours and some that have it as theirs, so that nobody is out of reach."""
    return _meetings(graph, reverse).groupBy(F.col("centre").alias("node")).agg(F.collect_list("node").alias("others"))


def search(graph: DataFrame, base: DataFrame, starts: DataFrame, n: int, size: int, ef: int = EF) -> DataFrame:
    """(query, node, score): the best ef nodes that a greedy walk from each start (query: a node) finds, itself included."""
    spark = base.sparkSession
    vec = base.select("node", "vec")
    qvec = tables.store(starts.join(vec.withColumnRenamed("node", "query"), "query").select("query", F.col("vec").alias("qvec")), "queries")
    few = n * (4 * size + 64) <= BROADCAST_BYTES
    wrap = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    schema = "query long, node long, score double"
    scored = lambda rows: rows.join(wrap(vec), "node").join(wrap(qvec), "query").select("query", "node", "qvec", "vec").mapInArrow(_scores(size), schema)
    entries = base.select(F.col("node").alias("entry"), "norm").orderBy(F.desc("norm"), F.xxhash64("node"), "node").limit(ENTRIES).agg(F.collect_list("entry").alias("entries"))
    # the entries are one row of a fixed size
    from_all = qvec.select("query").join(F.broadcast(entries), F.size("entries") > 0).select("query", F.explode(F.array_union("entries", F.array("query"))).alias("node"))
    order = (F.desc("score"), F.col("node"))
    best = F.row_number().over(W.partitionBy("query").orderBy(*order))
    turn = F.row_number().over(W.partitionBy("query").orderBy("seen", *order))

    def kept(rows: DataFrame) -> DataFrame:
        """The best ef of each query; now: those that the next step expands."""
        rows = rows.withColumn("r", best).where(F.col("r") <= ef).withColumn("r", turn)
        return tables.store(rows.select("query", "node", "score", "seen", (~F.col("seen") & (F.col("r") <= EXPANDED)).alias("now")), "beam")

    beam = kept(scored(from_all).withColumn("seen", F.lit(False)))
    while not beam.where("now").isEmpty():
        near = beam.where("now").select("query", "node").join(graph.select("node", "others"), "node").select("query", F.explode("others").alias("node")).distinct()
        found = scored(near.join(beam.select("query", "node"), ["query", "node"], "left_anti")).withColumn("seen", F.lit(False))
        new = kept(beam.select("query", "node", "score", (F.col("seen") | F.col("now")).alias("seen")).union(found))
        tables.drop(beam)
        beam = new
        tables.release(spark)
    return tables.store(beam.select("query", "node", "score"), "found")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query (vec_id, one of vectors), its own row excepted."""
    with tables.scratch() as keep:
        base, members, ids_of, named, size = nodes(vectors, k + 1)
        n = base.count()
        if not n:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        # an id that isn't among its node's smallest has the same neighbours as those
        asked = queries.select(F.col("vec_id").alias("query_id")).distinct().join(ids_of, F.col("query_id") == F.col("vec_id")).select("query_id", "node")
        asked = keep(tables.store(asked, "asked"))
        graph = build_graph(base, n, size)
        ways = tables.store(_ways(graph, REVERSE // 2), "ways")
        tables.drop(graph)
        found = keep(search(ways, base, asked.select(F.col("node").alias("query")).distinct(), n, size, ef))
        for t in (members, named):
            keep(t)
    # the score proper: from the original vectors, added up from the first component on
    zero = F.lit(0.0)
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, zero)), zero, lambda a, x: a + x)
    found = found.select("query", "node").join(named, "node").join(named.select(F.col("node").alias("query"), F.col("v").alias("q")), "query").select("query", "node", product.alias("score"))
    # a node stands for all its ids; one more than asked for, as the query itself goes
    ids = found.join(members, "node").select("query", "vec_id", "score")
    order = (F.desc("score"), F.col("vec_id"))
    ids = ids.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
    out = asked.join(ids, F.col("node") == F.col("query")).where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.pick(tables.read(spark, sf_dir, "embeddings"), "vec_id", "embedding").toDF("vec_id", "v")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
