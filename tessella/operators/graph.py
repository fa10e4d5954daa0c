"""Similarity pairs, duplicate verdicts, conflict groups, chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..functions.time import age_seconds
from ..sources import scratch

#: Rows of a part that meets another in one task, and rows of it that are compared at once (so a matrix has 2 million cells).
#: A row is copied once for each part of its block: the larger the parts, the less is shuffled.
BLOCK_ROWS, STEP_ROWS = 8192, 256
#: Tasks of _grid() at most, beyond which one takes several pairs of parts; types whose sizes are broadcast.
MOST_TASKS, FEW_TYPES = 20_000, 10_000
#: Pairs that leave a task in one batch.
BATCH_PAIRS = 100_000
#: Cells of similar_pairs(): fewer aren't worth it, more don't fit a worker's matrices; cells beyond are cut into parts.
LEAST_PIVOTS, MOST_PIVOTS = 4, 2048
#: Claims that are left when greedy_groups() ends in one task.
FEW_CLAIMS = 200_000
#: Columns of a record that tell whether another can contradict it.
_CONFLICT = ("created_at", "data_id", "source", "keywords")
Check = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
May = Callable[[pd.DataFrame], Check]
Allowed = Callable[[pd.DataFrame, pd.DataFrame], Callable[[slice, np.ndarray], np.ndarray]]


def _celled(rows: DataFrame, least: float) -> DataFrame:
    """rows with cell and home: each stands at home in the cell of its nearest pivot, and visits the earlier cells that may hold a match.

    By the triangle inequality of angles, a row within the limit's angle t of a member of cell j, whose widest member is r from
    its pivot, is within t + r of that pivot, and no further from it than from its own pivot plus 2 t; so no pair is missed.
    Pivots are rows, as many as there are blocks' worth of rows, at most MOST_PIVOTS; with few rows, or where the cells would be
    visited as often as parts of all rows, there is one cell.
    """
    plain = lambda: rows.withColumn("cell", F.lit(0)).withColumn("home", F.lit(True))
    if least <= 0:  # vectors without a direction have similarity 0 to all
        return plain()
    n = min(MOST_PIVOTS, rows.count() // BLOCK_ROWS)
    if n < LEAST_PIVOTS:
        return plain()
    directed = F.exists("embedding", lambda x: x != 0)
    some = rows.where(directed).select("uuid", "embedding").orderBy(F.xxhash64("uuid"), "uuid").limit(n).collect()
    pivots = np.array([r["embedding"] for r in some], float)
    pivots /= np.sqrt((pivots * pivots).sum(1))[:, None]
    reach = float(np.arccos(max(-1.0, least - 1e-6))) + 1e-6
    fields = ", ".join(f"{c} {k}" for c, k in rows.dtypes)

    def steps(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """A batch in turns: with many pivots, a whole one against all of them would take a worker's memory."""
        most = max(1, STEP_ROWS * BLOCK_ROWS // len(pivots))
        return (pdf.iloc[at : at + most] for at in range(0, len(pdf), most))

    def angles(pdf: pd.DataFrame) -> np.ndarray:
        return np.arccos(np.clip(_unit(pdf) @ pivots.T, -1, 1))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in steps(pdf):
                a = angles(some)
                yield some.assign(cell=a.argmin(1).astype("int32"), apart=a.min(1))

    settled = scratch.store(rows.where(directed).mapInPandas(settle, f"{fields}, cell int, apart double"), "cells")
    radius = np.full(len(pivots), -9.0)
    for r in settled.groupBy("cell").agg(F.max("apart").alias("r")).collect():  # one row a pivot
        radius[r["cell"]] = r["r"]

    def visited(pdf: pd.DataFrame) -> np.ndarray:
        a, cell = angles(pdf), pdf["cell"].to_numpy()
        return (a <= reach + radius + 1e-9) & (a <= pdf["apart"].to_numpy()[:, None] + 2 * reach + 1e-9) & (np.arange(len(pivots)) < cell[:, None])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in steps(pdf):
                i, j = np.nonzero(visited(some))
                met = pd.DataFrame({"block": pd.concat([some["block"], some["block"].iloc[i]]), "cell": np.concatenate([some["cell"], j])})
                yield met.groupby(["block", "cell"], dropna=False).size().reset_index(name="n")

    # copies of rows that the parts of cells make, against those that the parts of whole blocks make
    copies = lambda sizes: sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK_ROWS))).first()[0] or 0
    sizes = settled.select("block", "embedding", "cell", "apart").mapInPandas(number, f"block {dict(rows.dtypes)['block']}, cell int, n long")
    if copies(sizes.groupBy("block", "cell").agg(F.sum("n").alias("n"))) >= copies(settled.groupBy("block").agg(F.count("*").alias("n"))):
        return plain()

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), STEP_ROWS):
                some = pdf.iloc[at : at + STEP_ROWS]
                i, j = np.nonzero(visited(some))
                yield pd.concat([some.assign(home=True), some.iloc[i].assign(cell=j.astype("int32"), home=False)])

    return settled.mapInPandas(visit, f"{fields}, cell int, apart double, home boolean").drop("apart")


def similar_pairs(rows: DataFrame, least: float, most: int | None = None, extra: tuple[str, ...] = (), may: May | None = None, forest: bool = False) -> DataFrame:
    """(a, b, sim, block) with a < b and cosine at least ``least``, of rows (uuid, block, embedding) within a block.

    Rows meet in the cells around pivots that can hold a match, so where vectors lie in clusters what is shuffled grows
    with the rows; where they don't, all rows of a block are one cell. Large cells are cut into parts by a hash of uuid, and two
    parts meet in one task as matrices of STEP_ROWS by a part; only pairs at or above the limit leave it, in batches.
    ``may`` says which of a task's pairs count, from its rows (with the columns ``extra``), two arrays of places and the similarities.
    With ``most``, only the pairs that are among the ``most`` best of either row in their task are returned, ties to the smaller uuid:
    the ``most`` best of each row are all there. With ``forest``, a task returns (smallest, other, NaN) for the sets that its pairs
    connect: fewer rows than it has been given, with the components that all pairs have.
    """
    kept = scratch.store(rows.where("embedding is not null").select("uuid", "block", "embedding", *extra), "rows")
    held = _celled(kept, least)
    sizes = held.groupBy("block", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    dealt = held.join(sizes, ["block", "cell"]).withColumn("own", F.pmod(F.xxhash64("uuid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("block", "cell", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "home", "uuid", "embedding", *extra)

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, _, lo, hi = key
        t = pa.Table.from_batches(list(batches)).sort_by("uuid")
        x = _unit(t.select(["embedding"]).to_pandas())
        ids, own, home = t["uuid"].to_numpy(), t["own"].to_numpy(), t["home"].to_numpy()
        left, right = np.nonzero(own == lo.as_py())[0], np.nonzero(own == hi.as_py())[0]
        same = lo.as_py() == hi.as_py()
        check = may(t.select(list(extra)).to_pandas()) if may else None
        root = np.arange(len(ids))

        def found(some: np.ndarray, others: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sim = x[some] @ x[others].T
            i, j = np.nonzero(sim >= least - 1e-6)
            sim, i, j = np.round(np.clip(sim[i, j], -1, 1), 6), some[i], others[j]
            # visitors meet in the cell where one of them is at home
            ok = (sim >= least) & (home[i] | home[j]) & ((ids[i] < ids[j]) if once else (ids[i] != ids[j]))
            i, j, sim = i[ok], j[ok], sim[ok]
            if check is not None:
                ok = check(i, j, sim)
                i, j, sim = i[ok], j[ok], sim[ok]
            return i, j, sim

        def out(i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            for at in range(0, len(a), BATCH_PAIRS):
                n = len(a[at : at + BATCH_PAIRS])
                cut = [pa.array(c[at : at + BATCH_PAIRS]) for c in (a, b, sim)]
                yield pa.RecordBatch.from_arrays([*cut, pa.repeat(block, n)], ["a", "b", "sim", "block"])

        steps = lambda of: (of[at : at + STEP_ROWS] for at in range(0, len(of), STEP_ROWS))
        if most is not None:
            best = []
            for mine, others in [(left, right)] if same else [(left, right), (right, left)]:
                for some in steps(mine):
                    i, j, sim = found(some, others, False)
                    order = np.lexsort((ids[j], -sim, i))
                    i, j, sim = i[order], j[order], sim[order]
                    top = np.arange(len(i)) - np.searchsorted(i, i) < most
                    best.append((np.minimum(i[top], j[top]), np.maximum(i[top], j[top]), sim[top]))
            i, j, sim = (np.concatenate(c) for c in zip(*best)) if best else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            _, at = np.unique(i * len(ids) + j, return_index=True)
            yield from out(i[at], j[at], sim[at])
            return
        for some in steps(left):
            i, j, sim = found(some, right, same)
            if forest:
                _connect(root, i, j)
            else:
                yield from out(i, j, sim)
        if forest:
            j = np.nonzero(root != np.arange(len(ids)))[0]
            yield from out(root[j], j, np.full(len(j), np.nan))

    kind = dict(rows.dtypes)["block"]
    return dealt.groupBy("block", "cell", "lo", "hi").applyInArrow(compare, f"a long, b long, sim double, block {kind}")


def _connect(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of rows i and j in ``root``, each row's smallest row of its set."""

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in range(0, len(i), 4096):
        apart = at + np.nonzero(root[i[at : at + 4096]] != root[j[at : at + 4096]])[0]
        for k in apart:
            p, q = top(i[k]), top(j[k])
            root[max(p, q)] = min(p, q)
        while len(apart) and (root[root] != root).any():
            root[:] = root[root]


def nearest(rows: DataFrame) -> DataFrame:
    """(uuid, sim): each row's best similarity to another of its data_type; null if there is none."""
    return rows.select("uuid").join(best_matches(rows, rows).select("uuid", "sim"), "uuid", "left")


def _unit(rows: pd.DataFrame) -> np.ndarray:
    m = np.array(rows["embedding"].tolist(), float)
    norm = np.sqrt((m * m).sum(1))
    return np.divide(m, norm[:, None], out=np.zeros_like(m), where=norm[:, None] > 0)


def _grid(incoming: DataFrame, store: DataFrame, by: str | None, extra: tuple[str, ...] = ()) -> GroupedData:
    """Both sides dealt out in parts within a type; a group holds one part of each (``new`` tells them apart).

    Groups are numbered and each has a task of its own (up to MOST_TASKS of them), however few bytes it holds: a task's time is
    that of two parts, and it sorts no more than these.
    """

    def held(rows: DataFrame, name: str) -> DataFrame:
        kept = rows.select("uuid", (F.col(by) if by else F.lit(0)).alias("grp"), "embedding", *extra).where("embedding is not null and grp is not null")
        return scratch.store(kept, name)

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))

    a, b = held(incoming, "incoming"), held(store, "known")
    both = parts(a, "xs").join(parts(b, "ys"), "grp")
    # one row a type
    sizes = scratch.store(both.withColumn("first", F.sum(F.col("xs").cast("long") * F.col("ys")).over(W.orderBy("grp")) - F.col("xs").cast("long") * F.col("ys")), "sizes")
    types, groups = sizes.agg(F.count("*"), F.max(F.col("first") + F.col("xs") * F.col("ys"))).first()
    sizes = F.broadcast(sizes) if types <= FEW_TYPES else sizes
    own = lambda n: F.pmod(F.xxhash64("uuid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pair = (F.col("first") + F.col("x") * F.col("ys").cast("long") + F.col("y")).alias("pair")
    columns = (pair, "uuid", "embedding", *extra)
    left = a.join(sizes, "grp").withColumn("x", own("xs")).withColumn("y", every("ys")).select(*columns, F.lit(True).alias("new"))
    right = b.join(sizes, "grp").withColumn("y", own("ys")).withColumn("x", every("xs")).select(*columns, F.lit(False).alias("new"))
    tasks = max(1, min(groups or 1, MOST_TASKS))
    return left.union(right).withColumn("task", F.pmod("pair", F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task")).groupBy("task", "pair")


def top_matches(incoming: DataFrame, store: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(uuid, match, sim, rank): the k most similar other rows of each incoming row, ties to the smaller; a task returns k rows of a row at most."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        new, old = pdf[pdf["new"]], pdf[~pdf["new"]].sort_values("uuid")
        if not len(new) or not len(old):
            return pd.DataFrame({"uuid": [], "match": [], "sim": []})
        ids, others = new["uuid"].to_numpy(), old["uuid"].to_numpy()
        x, y, made = _unit(new), _unit(old), []
        for at in range(0, len(ids), STEP_ROWS):
            own = ids[at : at + STEP_ROWS]
            sim = np.round(np.clip(x[at : at + STEP_ROWS] @ y.T, -1, 1), 6)
            sim[own[:, None] == others[None, :]] = -2
            best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            made.append(pd.DataFrame({"uuid": np.repeat(own, best.shape[1]), "match": others[best].ravel(), "sim": np.take_along_axis(sim, best, 1).ravel()}))
        out = pd.concat(made)
        return out[out["sim"] >= -1]

    each = _grid(incoming, store, by).applyInPandas(compare, "uuid long, match long, sim double")
    w = W.partitionBy("uuid").orderBy(F.desc("sim"), "match")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_matches(incoming: DataFrame, store: DataFrame, by: str | None = "data_type", extra: tuple[str, ...] = (), allowed: Allowed | None = None) -> DataFrame:
    """(uuid, match, sim): each incoming row's most similar other row of its type in the store, ties to the smaller match.

    Both sides are dealt out in parts within a type (``by``; None: all are of one); a task compares one part of each as
    matrices, STEP_ROWS rows at once, and returns one row for each incoming row, so what is shuffled grows with the rows and
    parts, not with the pairs. ``allowed`` says, from the two parts (with the columns ``extra``), which pairs count.
    """
    return _best_each(incoming, store, by, extra, (allowed,)).select("uuid", "best0.match", "best0.sim")


def _best_each(incoming: DataFrame, store: DataFrame, by: str | None, extra: tuple[str, ...], checks: tuple[Allowed | None, ...]) -> DataFrame:
    """(uuid, best0, best1, ...): best_matches() for each of ``checks`` as a struct (match, sim), null if there is none, from one pass over the pairs."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        new, old = pdf[pdf["new"]], pdf[~pdf["new"]].sort_values("uuid")
        if not len(new) or not len(old):
            return pd.DataFrame({"uuid": [], "kind": [], "match": [], "sim": []})
        ids, others = new["uuid"].to_numpy(), old["uuid"].to_numpy()
        x, y, made = _unit(new), _unit(old), []
        oks = [allowed(new, old) if allowed is not None else None for allowed in checks]
        for at in range(0, len(ids), STEP_ROWS):
            some = slice(at, at + STEP_ROWS)
            sim = x[some] @ y.T
            itself = np.searchsorted(others, ids[some])
            for k in range(int((np.searchsorted(others, ids[some], "right") - itself).max())):
                row = np.nonzero((itself + k < len(others)) & (others[np.minimum(itself + k, len(others) - 1)] == ids[some]))[0]
                sim[row, itself[row] + k] = -2
            for kind, ok in enumerate(oks):
                if ok is None:
                    best, top = _first_best(sim)
                else:
                    held = np.round(np.maximum(np.minimum(sim, 1), np.where(sim < -1.5, -2, -1)), 6)
                    held[~ok(some, held)] = -2
                    best = held.argmax(1)  # the first of equal ones, so the smaller uuid
                    top = held[np.arange(len(best)), best]
                made.append(pd.DataFrame({"uuid": ids[some], "kind": kind, "match": others[best], "sim": top}))
        out = pd.concat(made)
        return out[out["sim"] >= -1]

    each = _grid(incoming, store, by, extra).applyInPandas(compare, "uuid long, kind int, match long, sim double")
    found = F.struct("sim", (-F.col("match")).alias("m"))
    best = each.groupBy("uuid").agg(*[F.max(F.when(F.col("kind") == k, found)).alias(f"b{k}") for k in range(len(checks))])
    return best.select("uuid", *[F.when(F.col(f"b{k}").isNotNull(), F.struct((-F.col(f"b{k}.m")).alias("match"), F.col(f"b{k}.sim").alias("sim"))).alias(f"best{k}") for k in range(len(checks))])


def _first_best(sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of each row's largest similarity to six places, the first of equal ones; -2 stands for none."""
    most = sim.max(1)
    top = np.where(most < -1.5, -2, np.round(np.clip(most, -1, 1), 6))
    # what rounds to the same lies within a millionth
    i, j = np.divmod(np.flatnonzero(sim >= most[:, None] - 1.1e-6), sim.shape[1])
    near = sim[i, j]
    same = np.where(near < -1.5, -2, np.round(np.clip(near, -1, 1), 6)) == top[i]
    best, (i, at) = np.zeros(len(sim), int), np.unique(i[same], return_index=True)
    best[i] = j[same][at]  # a row with a NaN has none
    return best, top


def dedup_verdict(incoming: DataFrame, store: DataFrame, duplicate: float, possible: float) -> DataFrame:
    """(uuid, match, sim, verdict) of each incoming row: its best match of the same type in the store."""
    out = incoming.select("uuid").join(best_matches(incoming, store), "uuid", "left")
    return out.withColumn("verdict", near_verdict(F.col("sim"), duplicate, possible))


def matched_and_contradicted(incoming: DataFrame, store: DataFrame, least: float, duplicate: float, jaccard_min: float) -> DataFrame:
    """(uuid, match, sim, contradicts): best_matches() and the match of contradictions(), from one pass over the pairs; rows that have neither are left out."""
    both = _best_each(incoming, store, "data_type", _CONFLICT, (None, _may_conflict(least, duplicate, jaccard_min)))
    return both.select("uuid", "best0.match", "best0.sim", F.col("best1.match").alias("contradicts"))


def near_verdict(sim: Column, duplicate: float, possible: float) -> Column:
    return F.when(sim >= duplicate, "duplicate").when(sim >= possible, "possible_duplicate").otherwise("new")


def guarded(a: str, b: str, days: float = 1, source_days: float = 30) -> Column:
    """Whether two records can be in conflict: same data_id (or none), apart in time, not the same source and id at near times."""
    apart = F.abs(age_seconds(F.col(f"{a}.created_at"), F.col(f"{b}.created_at"))) / 86400.0
    one_id = F.col(f"{a}.data_id").isNull() | F.col(f"{b}.data_id").isNull() | (F.col(f"{a}.data_id") == F.col(f"{b}.data_id"))
    same = F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & F.col(f"{a}.data_id").eqNullSafe(F.col(f"{b}.data_id"))
    return one_id & (apart >= days) & ~(same & (apart <= source_days))


def conflict_pairs(rows: DataFrame, cosine_min: float, jaccard_min: float, jaccard_max: float = 1.0, without_keywords: float = 0.95, forest: bool = False) -> DataFrame:
    """(a, b, sim) of live records of one type that say nearly, not exactly, the same; what can't be in conflict (guarded()) doesn't leave its task.

    ``forest``: see similar_pairs()."""

    def may(part: pd.DataFrame) -> Check:
        guard, overlap = _guard(part, part), _Overlap(part["keywords"])

        def check(i: np.ndarray, j: np.ndarray, sim: np.ndarray) -> np.ndarray:
            ok = guard(i, j)
            o = overlap.of(i[ok], j[ok])
            ok[ok] = np.where(np.isnan(o), sim[ok] >= without_keywords, (o > jaccard_min) & (o < jaccard_max))
            return ok

        return check

    return similar_pairs(rows.select("uuid", F.col("data_type").alias("block"), "embedding", *_CONFLICT), cosine_min, extra=_CONFLICT, may=may, forest=forest).select("a", "b", "sim")


def both_ways(edges: DataFrame) -> DataFrame:
    """edges (a, b, ...) and the same from b to a; they are worked out once."""
    rest = [c for c in edges.columns if c not in "ab"]
    ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(*rest, F.inline(ways)).select("a", "b", *rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over edges (a, b), by label propagation with pointer jumping; each round is stored, so its plan stays small."""
    both = scratch.store(both_ways(edges.where("a <> b").select("a", "b")).distinct(), "edges")
    labels = scratch.store(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    last = None
    while True:
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == last:
            return labels.withColumnRenamed("label", "component")
        last = total
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        near = labels.union(heard).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        labels = scratch.store(near.join(up, "label", "left").select("node", F.least("label", "above").alias("label")), "labels")


def winners(members: DataFrame) -> DataFrame:
    """Adds won: the most trusted, then newest, then smallest record of each component."""
    w = W.partitionBy("component").orderBy(F.desc("trust_score"), F.desc("created_at"), "uuid")
    return members.withColumn("won", F.row_number().over(w) == 1)


def greedy_groups(edges: DataFrame, rows: DataFrame, key: str, most_neighbours: int = 10, most_seeds: int | None = None, most_groups: int | None = None) -> DataFrame:
    """(grp, uuid): newest-updated seeds take those of their nearest neighbours that are free; groups of two or more, within each key.

    The groups of a pass over the seeds in that order, found in rounds: a seed claims itself and its nearest neighbours,
    and acts when it comes first among all open seeds that claim one of them, for then no earlier one can change what it
    finds. Seeds that are taken, or whose neighbours all are, are closed. A round costs joins of at most
    ``most_neighbours`` + 1 claims a seed; when at most FEW_CLAIMS are left, one task ends the pass.
    ``most_seeds`` and ``most_groups`` stop the pass after so many seeds and groups.
    """
    u = rows.select("uuid", "updated_at", key)
    full = edges.join(u.select(F.col("uuid").alias("a"), F.col(key).alias("ka")), "a").join(u.select(F.col("uuid").alias("b"), F.col(key).alias("kb")), "b").where("ka = kb")
    both = scratch.store(both_ways(full.select("a", "b", "sim")).toDF("seed", "node", "sim"), "both")
    w = W.partitionBy("seed").orderBy(F.desc("sim"), "node")
    near = both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most_neighbours).select("seed", "node")
    order = F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("t"), F.col("uuid").alias("u"))
    seeds = both.select(F.col("seed").alias("uuid")).distinct().join(u, "uuid").select(F.col("uuid").alias("seed"), order.alias("place"))
    if most_seeds is not None:
        seeds = seeds.orderBy("place").limit(most_seeds)
    claims = near.join(seeds, "seed").union(seeds.select("seed", F.col("seed").alias("node"), "place"))
    claims = scratch.store(claims, "claims")
    made: list[DataFrame] = []

    def act(seed_claims: DataFrame) -> DataFrame:
        """The free neighbours of seeds that act: claims hold nothing that is taken."""
        return seed_claims.where("seed <> node").select(F.col("seed").alias("grp"), F.col("node").alias("uuid"), "place")

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[int] = set()
        out = []
        for seed, nodes in sorted(((k, g) for k, g in pdf.groupby("seed")), key=lambda x: (x[1]["t"].iloc[0], x[0])):
            free = [n for n in nodes["node"] if n not in taken and n != seed]
            if seed not in taken and free:
                taken.update([seed, *free])
                out += [(seed, n, nodes["t"].iloc[0]) for n in free]
        return pd.DataFrame(out, columns=["grp", "uuid", "t"])

    while True:
        if claims.count() <= FEW_CLAIMS:
            last = claims.select("seed", "node", F.col("place.t").alias("t"), F.lit(0).alias("all")).groupBy("all").applyInPandas(rest, "grp long, uuid long, t long")
            made.append(last.select("grp", "uuid", F.struct("t", F.col("grp").alias("u")).alias("place")))
            break
        first = claims.groupBy("node").agg(F.min("place").alias("first"))
        acting = claims.join(first, "node").groupBy("seed").agg(F.bool_and(F.col("place") == F.col("first")).alias("acts")).where("acts").select("seed")
        acts = scratch.store(claims.join(acting, "seed", "left_semi"), "acts")
        groups = scratch.store(act(acts), "groups")
        made.append(groups)
        taken = groups.select("grp").union(groups.select("uuid")).toDF("node").distinct()
        open_ = claims.join(acting, "seed", "left_anti").join(taken.toDF("seed"), "seed", "left_anti").join(taken, "node", "left_anti")
        # a seed that only claims itself finds nothing any more
        alone = open_.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
        claims = scratch.store(open_.join(alone, "seed", "left_semi").select("seed", "node", "place"), "claims")
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    if most_groups is not None:
        kept = out.select("grp", "place").distinct().orderBy("place").limit(most_groups)
        out = out.join(kept.select("grp"), "grp", "left_semi")
    return out.select("grp", "uuid").union(out.select("grp", F.col("grp").alias("uuid")).distinct())


def chain_roots(parents: DataFrame) -> DataFrame:
    """(node, root, depth) of rows (node, parent), by doubling the pointers until all stand at a root."""
    scratch.checkpoints(parents.sparkSession)
    now = parents.select("node", F.coalesce("parent", F.col("node")).alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")).checkpoint()
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        new = now.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()
        if new.agg(F.sum("depth")).first()[0] == now.agg(F.sum("depth")).first()[0]:
            return new
        now = new


def _guard(new: pd.DataFrame, old: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """guarded() for places in two parts, which may be given as a column and a row."""

    def codes(c: str) -> tuple[np.ndarray, np.ndarray]:
        number = pd.factorize(pd.concat([new[c], old[c]], ignore_index=True))[0].astype("int32")  # null: -1
        return number[: len(new)], number[len(new) :]

    (a, b), (x, y) = codes("data_id"), codes("source")
    s, t = ((rows["created_at"].to_numpy("datetime64[us]") - np.datetime64(0, "us")) / np.timedelta64(1, "us") for rows in (new, old))  # null: NaN
    day = 86_400_000_000

    def guard(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = np.abs(s[i] - t[j])
        p, q = a[i], b[j]
        same_id = p == q
        return (same_id | (p < 0) | (q < 0)) & (apart >= day) & ~(same_id & (apart <= 30 * day) & (x[i] == y[j]))

    return guard


class _Overlap:
    """Keyword overlaps of rows: all words by number, a row's own ones once each."""

    def __init__(self, keywords: pd.Series):
        sets = [set(k) if k is not None else set() for k in keywords]
        number: dict = {}
        self.size = np.array([len(s) for s in sets], int)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.words = np.array([number.setdefault(w, len(number)) for s in sets for w in s], int)
        self.row = np.repeat(np.arange(len(sets)), self.size)
        self.n_words = max(1, len(number))
        self.keys = np.sort(self.row * self.n_words + self.words)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """jaccard() of rows i and j, NaN where one has no words."""
        common = np.zeros(len(i), int)
        for k in range(int(self.size[i].max()) if len(i) else 0):
            has = np.nonzero(self.size[i] > k)[0]
            key = j[has] * self.n_words + self.words[self.at[i[has]] + k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            common[has] += self.keys[at] == key
        m, n = self.size[i], self.size[j]
        return np.divide(common, m + n - common, out=np.full(len(i), np.nan), where=(m > 0) & (n > 0))


def _may_conflict(least: float, duplicate: float, jaccard_min: float) -> Allowed:
    """guarded() and the limits of contradictions(), for rows of one part against another."""

    def allowed(new: pd.DataFrame, old: pd.DataFrame) -> Callable[[slice, np.ndarray], np.ndarray]:
        guard = _guard(new, old)
        own = [set(k) if k is not None else set() for k in new["keywords"]]
        known = [set(k) if k is not None else set() for k in old["keywords"]]
        size = np.array([len(k) for k in known], int)
        at: dict = {}
        for j, ks in enumerate(known):
            for k in ks:
                at.setdefault(k, []).append(j)
        at = {k: np.array(js) for k, js in at.items()}
        everywhere = np.arange(len(old))[None, :]

        def ok(some: slice, sim: np.ndarray) -> np.ndarray:
            first = some.start
            out = guard(np.arange(first, first + len(sim))[:, None], everywhere) & (sim >= least) & (sim < duplicate)
            for r in np.nonzero(out.any(1))[0]:
                words = own[first + r]
                if words:
                    met = [at[w] for w in words if w in at]
                    common = np.bincount(np.concatenate(met), minlength=len(size)) if met else np.zeros(len(size), int)
                    overlap = common / (len(words) + size - common)
                    out[r] &= (size == 0) | (overlap >= jaccard_min) & (overlap < 1.0)
            return out

        return ok

    return allowed


def contradictions(incoming: DataFrame, store: DataFrame, least: float, duplicate: float, jaccard_min: float) -> DataFrame:
    """(uuid, match, sim): the nearest stored record that an incoming one may contradict; a missing keyword overlap passes."""
    return best_matches(incoming, store, extra=_CONFLICT, allowed=_may_conflict(least, duplicate, jaccard_min))


def echoes(rows: DataFrame, surfaced: DataFrame, limit: float) -> DataFrame:
    """(uuid, sim, echo): how near each row is to what a session has shown."""
    return best_matches(rows, surfaced, by=None).select("uuid", "sim").withColumn("echo", F.col("sim") >= limit)


def duplicate_edges(live: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """Similar pairs of one type and source that may be merged; with ``most``, as few as hold the ``most`` best of each."""
    rows = live.where("not protected and priority < 2").select("uuid", F.concat_ws("|", "data_type", "source").alias("block"), "embedding")
    return similar_pairs(rows, least, most)


def _with_successor(rows: DataFrame) -> DataFrame:
    return rows.join(rows.select(F.col("uuid").alias("superseded_by"), F.col("status").alias("next_status")), "superseded_by", "left")


def heads(rows: DataFrame) -> DataFrame:
    """Active records that no active record supersedes."""
    return _with_successor(rows).where("status = 'active' and (superseded_by is null or next_status is null or next_status <> 'active')")


def released(rows: DataFrame) -> DataFrame:
    """Superseded records whose successor is gone or retired."""
    return _with_successor(rows).where("superseded_by is not null and (next_status is null or next_status <> 'active')")


def parents(merged: DataFrame, rows: DataFrame) -> DataFrame:
    """(merged, parent, source) of the parents that survive."""
    ids = merged.select(F.col("uuid").alias("merged"), F.explode("compacted_from").alias("parent"))
    return ids.join(rows.select(F.col("uuid").alias("parent"), "source"), "parent").select("merged", "parent", "source")


def repaired(merged: DataFrame, rows: DataFrame) -> DataFrame:
    """(uuid, source, first_observed_at): provenance of merged records from their parents; vault notes win over untrusted ones over merges."""
    from ..functions.text import TRUSTED_SOURCES

    ids = merged.select(F.col("uuid").alias("merged"), F.explode("compacted_from").alias("parent"))
    p = ids.join(rows.select(F.col("uuid").alias("parent"), "source", "created_at"), "parent")
    untrusted = F.min(F.when(~F.col("source").isin(*TRUSTED_SOURCES), F.col("source")))
    source = F.when(F.bool_or(F.col("source") == "obsidian"), "obsidian").when(untrusted.isNotNull(), untrusted).otherwise("consolidated")
    return p.groupBy(F.col("merged").alias("uuid")).agg(source.alias("source"), F.min("created_at").alias("first_observed_at"))
