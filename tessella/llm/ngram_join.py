"""N-gram Jaccard join (operator 7): vertical partitioning of the global n-gram order.

N-grams are 64-bit hashes of word shingles; the global order is that of the hashes, cut
into ranges. What documents have in common is counted in each range apart and summed for
each document or pair, so no task sees more than a range, and no pair is emitted for
documents that merely share something.

1. ``sketch``: every document's set is hashed to a class (equal sets are one class) and
   the first part of its order, enough for a partner to share ``depth`` of its n-grams,
   goes to ranges. A task first combines what its own documents share, so a frequent
   n-gram costs a row for each task and not for each document. Each range counts for
   each class the n-grams that another class has too; the counts are summed. A class
   with fewer than a partner must share is done.
2. ``token_sets``: the whole sets of the remaining classes, from one document of each.
3. Leaders: each class is compared with the most typical class of its min-hash groups, a
   linear number of pairs that joins large groups of near copies. Components follow.
4. Prefix filtering finds every remaining pair of classes in different components: a
   class's rarest n-grams (by a fixed-size frequency sketch; any order is right) must
   meet. Groups within one component drop out, so a group of near copies costs no pairs,
   and the classes of an n-gram with many pairs left are compared in blocks.
5. Pairs are verified exactly: partial overlaps in each range of the order, summed.

Defined cases: a null text is empty; texts without words have an empty set and no links;
equal rows are one class; a text with fewer words than a shingle is one shingle; null
doc_ids are kept, and a component's name is its smallest doc_id that isn't null (null if
all are); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, shingles, tables, workers

PERCENT = 75
#: n-grams sent to a range, about, and those a task combines before it sends them.
RANGE_TOKENS = 400_000
TASK_TOKENS = 500_000
#: A partner must share a part of the first n-grams: 1 in DEPTH of the set.
DEPTH = 10
FRAGMENTS = 8
HASHES = 4
CELLS, ADDED = 1 << 22, 64
#: Pairs of an n-gram that are joined as rows; beyond it, classes are compared in blocks of about so many.
PAIRS, BLOCK = 2_000, 400
#: Classes whose names may be broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def needed(n):
    """The least overlap with any partner of a set of n."""
    return -(-PERCENT * n // 100)


def depth(n):
    return np.maximum(1, n // DEPTH)


def _ranges(tokens: np.ndarray, parts: int) -> np.ndarray:
    return (((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def _keyed(docs: DataFrame) -> DataFrame:
    """key names a row even where doc_id is null."""
    rows = tables.doc_columns(docs)
    return rows.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "text")


def _tidy(run):
    """A function of a task's batches that leaves no large memory behind in its worker."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.none()
        try:
            yield from run(batches)
        finally:
            workers.trim()

    return call


_SENT = "range int, tokens binary, classes binary, known binary, counted binary, counts binary, kind int, a long, b long, c long"
_SENT_ARROW = [("range", pa.int32()), *((c, pa.binary()) for c in ("tokens", "classes", "known", "counted", "counts")), ("kind", pa.int32()), *((c, pa.int64()) for c in "abc"), ("d", pa.int64())]


def _sketch_rows(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [k for _, k in _SENT_ARROW]
    names = [n for n, _ in _SENT_ARROW]
    held: list[np.ndarray] = []
    seen: dict[int, None] = {}
    size = 0
    turn = 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def flush() -> pa.RecordBatch:
        nonlocal held, seen, size, turn
        tokens = np.concatenate(held)
        own = np.repeat(np.array(list(seen), np.int64), [len(x) for x in held])
        order = np.argsort(tokens, kind="stable")
        tokens, own = tokens[order], own[order]
        same = np.r_[False, tokens[1:] == tokens[:-1]]
        shared = same.copy()
        shared[:-1] |= same[1:]
        who, often = np.unique(own[shared], return_counts=True)
        tokens, own, shared = tokens[~same], own[~same], shared[~same]
        cuts = np.searchsorted(_ranges(tokens, parts), np.arange(parts + 1))
        rows = [
            (r, tokens[a:b].tobytes(), own[a:b].tobytes(), shared[a:b].tobytes(), None, None, 0, None, None, None, None)
            for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            if a < b
        ]
        turn += 1
        rows.append((turn % parts, None, None, None, who.tobytes(), often.astype(np.int64).tobytes(), 0, None, None, None, None))
        held, seen, size = [], {}, 0
        return batch_of(rows)

    for batch in batches:
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
        info = []
        for row, tokens in shingles.of_column(batch.column("text")):
            n = len(tokens)
            name = shingles.set_hash(tokens)
            info.append((keys[row] % parts, None, None, None, None, None, 1, ids[row], name, n, keys[row]))
            if n and name not in seen:
                take = tokens[: min(n, n - needed(n) + int(depth(n)))]
                held.append(take)
                seen[name] = None
                size += len(take)
                if size >= TASK_TOKENS:
                    yield flush()
        if info:
            yield batch_of(info)
    if held:
        yield flush()


def _count_range(table: pa.Table) -> pa.Table:
    """Rows about documents as they are; for classes, how many n-grams of this range another class has."""
    about = table.filter(pa.compute.equal(table["kind"], 1)).select(["kind", "a", "b", "c", "d"])
    rest = table.filter(pa.compute.equal(table["kind"], 0))
    join = lambda c, kind: np.frombuffer(b"".join(x for x in rest[c].to_pylist() if x), kind)
    tokens, own, known = join("tokens", np.uint64), join("classes", np.int64), join("known", bool)
    order = np.lexsort((own, tokens))
    tokens, own, known = tokens[order], own[order], known[order]
    first = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.zeros(0, bool)
    run = np.cumsum(first) - 1
    again = np.r_[False, (own[1:] == own[:-1]) & ~first[1:]] if len(tokens) else first
    many = np.bincount(run[~again], minlength=run[-1] + 1 if len(run) else 0) > 1
    many |= np.bincount(run[known], minlength=len(many)) > 0
    credit = own[many[run] & ~again & ~known] if len(run) else own
    who, often = np.unique(np.r_[credit, np.repeat(join("counted", np.int64), join("counts", np.int64))], return_counts=True)
    del tokens, own, known, order, run, credit
    workers.trim()
    made = pa.table({"kind": pa.array(np.zeros(len(who), np.int32)), "a": pa.nulls(len(who), pa.int64()), "b": pa.array(who), "c": pa.array(often.astype(np.int64)), "d": pa.nulls(len(who), pa.int64())})
    return pa.concat_tables([about.cast(made.schema), made])


def sketch(docs: DataFrame) -> DataFrame:
    """kind 1: a document (a doc_id, b class, c size of its set, d key); kind 0: class b shares c n-grams in one range."""
    # about 0.35 of the shingles, one for six characters
    chars = tables.pick(docs, "text").agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, int(chars * 0.06 / RANGE_TOKENS) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sketch_rows(parts, batches)

    sent = _keyed(docs).mapInArrow(_tidy(run), _SENT + ", d long")
    return tables.store(sent.groupBy("range").applyInArrow(_count_range, "kind int, a long, b long, c long, d long"), "sketch")


def token_sets(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(class, n, tokens) of the classes that may have a partner, each once."""
    # how many rows have a class's key: those that repeat (doc_id and text) all come out of the join below
    about = sketched.where("kind = 1 and c > 0").groupBy("b", "d").agg(F.first("c").alias("n"), F.count("*").alias("m"))
    about = about.groupBy("b").agg(F.min(F.struct("d", "n", "m")).alias("x")).select("b", F.col("x.d").alias("key"), F.col("x.n").alias("n"), F.col("x.m").alias("m"))
    shared = sketched.where("kind = 0").groupBy("b").agg(F.sum("c").alias("shared"))
    least = F.floor((F.col("n") * PERCENT + 99) / 100)
    bound = F.greatest(F.lit(1), F.floor(least / DEPTH))
    chosen = about.join(shared, "b").where(F.col("shared") >= bound).select("key", F.col("b").alias("class"), "m")
    chosen = tables.store(chosen, "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("class").to_pylist()
            rows = [(wanted[i], len(t), t.tobytes()) for i, t in shingles.of_column(batch.column("text")) if shingles.set_hash(t) == wanted[i]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["class", "n", "tokens"])

    def of(some: DataFrame) -> DataFrame:
        return _keyed(docs).join(some, "key").select("class", "text").mapInArrow(_tidy(run), "class long, n long, tokens binary")

    repeated = chosen.where("m > 1")
    if repeated.isEmpty():
        sets = of(_small(chosen))
    else:
        # only sets of rows that repeat are shuffled, one for each task that has a copy
        sets = of(_small(chosen.where("m = 1"))).union(of(_small(repeated)).dropDuplicates(["class"]))
    return tables.store(sets, "sets", codec="uncompressed")


def frequencies(sets: DataFrame) -> np.ndarray:
    """How often n-grams fall into each of CELLS cells: a table of fixed size, whatever the input, added up ADDED tables at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells = np.zeros(CELLS, np.int32)
        for batch in batches:
            if batch.num_rows:
                cells += np.bincount(_cell(np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint64)), minlength=CELLS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], ["part", "cells"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        for x in table["cells"].to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int32)
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pa.table({"part": pa.array([table["grp"][0].as_py()], pa.int32()), "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    rows = tables.store(sets.select("tokens").mapInArrow(_tidy(run), "part int, cells binary"), "cells", codec="uncompressed")
    parts = rows.agg(F.max("part")).first()[0] or 0
    while parts > 0:
        rows = tables.store(rows.withColumn("grp", F.floor(F.col("part") / ADDED).cast("int")).groupBy("grp").applyInArrow(add, "part int, cells binary"), "cells", codec="uncompressed")
        parts //= ADDED
    row = rows.first()
    return np.frombuffer(zlib.decompress(row["cells"]), np.int32) if row else np.zeros(CELLS, np.int32)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(CELLS - 1)).astype(np.int64)


def _leaders(sets: DataFrame, cells: np.ndarray) -> DataFrame:
    """Pairs of a class and the leader of one of its HASHES min-hash groups: the class whose n-grams are most frequent.

    Of a group of near copies that is the one with the fewest changes, to which most others are near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log2(cells + 1.0).astype(np.float32)
        for batch in batches:
            rows = []
            for name, t in zip(batch.column("class").to_pylist(), batch.column("tokens").to_pylist()):
                t = np.frombuffer(t, np.uint64)
                central = float(logs[_cell(t)].mean())
                rows += [(int(shingles.mix(t ^ np.uint64(7919 * (k + 1))).min().view(np.int64)), name, central) for k in range(HASHES)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], ["sign", "class", "central"])

    signs = sets.select("class", "tokens").mapInArrow(_tidy(run), "sign long, class long, central double")
    first = signs.groupBy("sign").agg(F.max(F.struct("central", "class")).alias("lead"), F.count("*").alias("m")).where("m > 1").select("sign", F.col("lead.class").alias("a"))
    met = signs.join(first, "sign").where("a <> class")
    return met.select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")).distinct()


def _small(stored: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most BROADCAST_ROWS (narrow) rows."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link: partial overlaps are counted in each range of the order and summed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = batch.column("class").to_pylist(), batch.column("n").to_pylist()
            rows = []
            for name, n, t in zip(names, sizes, batch.column("tokens").to_pylist()):
                t = np.frombuffer(t, np.uint64)
                at = np.searchsorted(_ranges(t, FRAGMENTS), np.arange(FRAGMENTS + 1))
                rows += [(name, n, f, t[at[f] : at[f + 1]].tobytes()) for f in range(FRAGMENTS) if at[f] < at[f + 1]]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["class", "n", "range", "tokens"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                out.append(int((x[at] == y).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(out, pa.int64())], ["a", "b", "na", "nb", "o"])

    sizes = sets.select("class", "n")
    fits = (
        pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    )
    fits = tables.store(fits, "fits")
    ends = _small(tables.store(fits.select(F.col("b").alias("class")).distinct(), "ends"))
    pieces = lambda some: some.mapInArrow(_tidy(cut), "class long, n long, range int, tokens binary")
    x = pieces(sets).select(F.col("class").alias("a"), "range", F.col("tokens").alias("x")).join(_small(fits), "a")
    y = pieces(sets.join(ends, "class", "left_semi")).select(F.col("class").alias("b"), "range", F.col("tokens").alias("y"))
    xy = x.join(y, ["b", "range"])
    partial = xy.select("a", "b", "na", "nb", "x", "y").mapInArrow(_tidy(count), "a long, b long, na long, nb long, o long")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return summed.where(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * PERCENT).select("a", "b")


def _across(sets: DataFrame, cells: np.ndarray, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, links): all that can link classes of different components, by prefix filtering with the rarest n-grams first.

    An n-gram whose classes would make more than PAIRS pairs isn't joined: its classes are dealt out in blocks,
    two blocks to a task, and compared there; only links come out of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, t in zip(batch.column("class").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens").to_pylist()):
                t = np.frombuffer(t, np.uint64)
                first = t[np.lexsort((t, cells[_cell(t)]))[: n - needed(n) + 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(len(first), name)), pa.array(np.full(len(first), n)), pa.array(np.arange(len(first)))], ["token", "class", "n", "at"])

    rows = sets.mapInArrow(_tidy(_joined(run)), "token long, class long, n long, at long")
    known = labels.select(F.col("node").alias("class"), "component")
    known = F.broadcast(known) if labels.count() <= BROADCAST_ROWS else known
    rows = rows.join(known, "class", "left").withColumn("component", F.coalesce("component", "class"))
    rows = tables.store(rows, "prefixes")
    # n-grams that only one component has need no pairs
    several = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    mixed = tables.store(rows.join(several, "token", "left_semi"), "mixed")
    tables.drop(rows)
    sizes = mixed.groupBy("token", "component").count()
    main = sizes.groupBy("token").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("m"), F.max("count").alias("k"))
    main = tables.store(main, "main")
    heavy = F.col("m") * (F.col("m") - F.col("k")) > PAIRS
    light = main.where(~heavy).select("token", "main")
    # at least one of a pair is outside the largest component of the n-gram
    rest = mixed.join(light, "token").where("component <> main").select("token", "main", F.col("class").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("component").alias("ca"))
    every = mixed.select("token", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("component").alias("cb"))
    bound = F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    met = rest.join(every, "token").where(
        (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
        & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
        & (bound * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT)
    )
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    blocks = main.where(heavy).select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = mixed.join(blocks, "token").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "class", "component")
    full = dealt.join(sets.select("class", "tokens"), "class")
    links = full.groupBy("token", "lo", "hi").applyInArrow(_compare_blocks, "a long, b long")
    return pairs, links.distinct()


def _compare_blocks(table: pa.Table) -> pa.Table:
    """Links of classes in two blocks, of different components, as many as join the components (a forest)."""
    names, parts, own, lo = (table[c].to_numpy() for c in ("class", "component", "own", "lo"))
    # a fixed order, so that a task that runs again finds the same forest
    order = np.lexsort((names, own))
    names, parts, own, lo = names[order], parts[order], own[order], lo[order]
    raw = table["tokens"].to_pylist()
    sets = [np.frombuffer(raw[i], np.uint64) for i in order]
    n = np.array([len(t) for t in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    kept = often[code] > 1
    number = np.cumsum(often > 1) - 1
    code, row = number[code[kept]], row[kept]
    # partial overlaps in one range of n-grams after the other
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    by_code = np.argsort(code, kind="stable")
    code, row = code[by_code], row[by_code]
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, (first, first + 4096))
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[a:b], code[a:b] - first] = 1
        overlap += part @ part.T
    link = overlap * 100 >= (n[:, None] + n[None, :] - overlap) * PERCENT
    link &= (parts[:, None] != parts[None, :]) & (names[:, None] < names[None, :])
    if (lo != own).any() and (lo == own).any():
        link &= own[:, None] != own[None, :]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(link)):
        x, y = find(int(parts[i])), find(int(parts[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(names[i]), int(names[j])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _joined(run):
    """run() with its small batches put together."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in run(batches):
            held.append(b)
            size += b.num_rows
            if size >= 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return call


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class, key) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    with tables.scratch() as keep:
        sketched = keep(sketch(docs))
        tables.release(spark)
        sets = token_sets(docs, sketched)
        cells = frequencies(sets)
        near = tables.store(verified(_leaders(sets, cells), sets), "links")
        tables.release(spark)
        labels = components.connected_components(near)
        pairs, links = _across(sets, cells, labels)
        more = tables.store(verified(pairs, sets), "links")
        links = tables.store(links, "links")
        tables.release(spark)
        labels = components.connected_components(near.union(more).union(links))
        keep(labels)
    about = sketched.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("class"), F.col("c").alias("n_shingles"), F.col("d").alias("key"))
    rows = about.join(labels.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    # what a component's name needs is summed in each task first
    names = rows.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = rows.join(names, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "class", "key")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(tables.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
