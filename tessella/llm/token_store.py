"""Token-ID / binary output (operator 4): a Re-Pair compressed, randomly accessible token store.

``write_store`` encodes every whole text, appends an end id, and writes the ids in
ascending doc_id order. The order comes from one range shuffle; each range part is cut
into blocks of about ``block_tokens`` ids (a document never straddles two blocks), and
each block is compressed by its own Re-Pair grammar: in rounds, the most frequent
adjacent pairs get nonterminals and all their non-overlapping occurrences are replaced.

File format: a Parquet data set with one row for each block. ``rules`` holds the two
symbols of each nonterminal, ``lengths`` the number of ids each one expands to, and
``symbols`` the final sequence; ``doc_id`` and ``doc_tokens`` list the block's documents.
Rounds go on until no pair repeats or the nonterminals of a block (what 16 or 32 bits leave)
run out. ``read_store`` decodes all documents; ``read_documents`` finds the blocks of those
asked for and expands only the symbols that cover them.

Defined cases: a null text is empty and yields the end id alone; a null doc_id sorts
first; rows that repeat a doc_id keep a row each, in order of their texts' hash; an
empty table yields an empty store; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import encoding, tables

BLOCK_TOKENS = 1 << 20
LEAST_COUNT = 2
#: A round takes two thirds of the nonterminals that are left, or all if they are at most this many.
LAST_ROOM = 4096
STORE_SCHEMA = (
    "part int, block int, before long, n_tokens long, doc_id array<bigint>, doc_tokens array<int>, "
    "base int, rules binary, lengths binary, symbols binary"
)


def compress(ids: np.ndarray, base: int, rounds: int | None = None, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, symbols) of a Re-Pair grammar; ids are below ``base``.

    Rounds go on (at most ``rounds``) until no pair is there ``least`` times or nonterminals run out.
    16-bit symbols are used as long as base leaves room for nonterminals, else 32-bit.
    """
    kind, half, top = (np.uint16, np.uint32(16), 1 << 16) if base < (1 << 16) - 1024 else (np.uint32, np.uint64(32), 1 << 32)
    key_kind = np.uint32 if kind is np.uint16 else np.uint64
    seq = ids.astype(kind)
    rules = np.zeros((0, 2), kind)
    lengths = np.zeros(0, np.uint32)
    width = 18
    for turn in itertools.count() if rounds is None else range(rounds):
        room = min(top - base - len(rules), 1 << 14)
        if len(seq) < 2 or room <= 0:
            break
        keys = (seq[:-1].astype(key_kind) << half) | seq[1:]
        ordered = np.sort(keys)
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        counts = np.diff(np.r_[first, len(ordered)])
        often = np.flatnonzero(counts >= least)
        # later rounds need nonterminals too; when few are left they all go
        most = room if room <= LAST_ROOM or rounds is not None and turn == rounds - 1 else room * 2 // 3
        if len(often) > most:
            often = often[np.argpartition(-counts[often], most - 1)[:most]]
        often = often[np.argsort(-counts[often], kind="stable")]
        pairs = ordered[first[often]]
        if not len(pairs):
            break
        # open hash table of the chosen pairs: where two meet, the more frequent stays
        slot = _slots(pairs, width)
        held = np.zeros(1 << width, key_kind)
        number = np.full(1 << width, -1, np.int32)
        held[slot[::-1]] = pairs[::-1]
        pairs = pairs[held[slot] == pairs]
        number[_slots(pairs, width)] = np.arange(len(pairs), dtype=np.int32)
        slot = _slots(keys, width)
        at = np.flatnonzero(held[slot] == keys)
        at = at[number[slot[at]] >= 0]
        # of overlapping occurrences every second one is replaced, from the left
        heads = np.r_[True, np.diff(at) != 1]
        place = np.arange(len(at))
        at = at[(place - np.maximum.accumulate(np.where(heads, place, 0))) % 2 == 0]
        seq[at] = (base + len(rules) + number[slot[at]]).astype(kind)
        left = np.ones(len(seq), bool)
        left[at + 1] = False
        seq = seq[left]
        new = np.stack([(pairs >> half).astype(kind), pairs.astype(kind)], 1)
        size = np.ones((len(new), 2), np.uint32)
        deep = new >= base
        size[deep] = lengths[new[deep].astype(np.int64) - base]
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, size.sum(1, dtype=np.uint32)])
    return rules, lengths, seq


def _slots(keys: np.ndarray, width: int) -> np.ndarray:
    if keys.dtype == np.uint32:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - width)
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width)).astype(np.int64)


class Grammar:
    """Decodes a block's symbols, whole or in part."""

    def __init__(self, base: int, rules: np.ndarray, lengths: np.ndarray):
        self.base, lengths = base, lengths.astype(np.int64)
        self.start = np.cumsum(lengths) - lengths
        self.length = lengths
        self.table = np.zeros(int(lengths.sum()), np.uint32)
        # a rule uses only earlier rules, so rules of one depth expand together
        depth = np.zeros(len(rules), np.int64)
        deep = rules >= base
        for _ in range(len(rules)):
            inner = np.where(deep, depth[np.where(deep, rules.astype(np.int64) - base, 0)] + 1, 0).max(1) if len(rules) else depth
            if (inner == depth).all():
                break
            depth = inner
        for d in range(int(depth.max(initial=-1)) + 1):
            own = np.flatnonzero(depth == d)
            ids, sizes = self._expand(rules[own].reshape(-1))
            total = sizes.reshape(-1, 2).sum(1)
            to = np.repeat(self.start[own] - (np.cumsum(total) - total), total) + np.arange(total.sum())
            self.table[to] = ids

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        deep = np.flatnonzero(symbols >= self.base)
        out[deep] = self.length[symbols[deep].astype(np.int64) - self.base]
        return out

    def _expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes(symbols)
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        deep = symbols >= self.base
        out[(ends - 1)[~deep]] = symbols[~deep]
        number, size = symbols[deep].astype(np.int64) - self.base, sizes[deep]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat((ends - sizes)[deep], size) + step] = self.table[np.repeat(self.start[number], size) + step]
        return out, sizes

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self._expand(symbols)[0]


class Block:
    """A block's grammar and symbols, with where each symbol's expansion ends: random access to its ids."""

    def __init__(self, grammar: Grammar, symbols: np.ndarray):
        self.grammar, self.symbols = grammar, symbols
        self.ends = np.cumsum(grammar.sizes(symbols))

    def decode_range(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from ``start`` on, expanding only the symbols that cover them."""
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, start + length, "left") + 1
        before = int(self.ends[a - 1]) if a else 0
        return self.grammar.expand(self.symbols[a:b])[start - before : start - before + length]


def _blocks(part: int, path: str, end_id: int, block_tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = encoding.encoder(path)
    base = max(enc.model.get_vocab_size(), end_id + 1)
    names: list[int | None] = []
    held: list[np.ndarray] = []
    block = before = size = 0
    end = np.array([end_id], enc.dtype)

    def flush() -> pa.RecordBatch:
        nonlocal names, held, block, before, size
        rules, lengths, symbols = compress(np.concatenate([x for ids in held for x in (ids, end)]), base)
        row = {
            "part": [part], "block": [block], "before": [before], "n_tokens": [size], "doc_id": [names],
            "doc_tokens": [[len(x) + 1 for x in held]], "base": [base],
            "rules": [rules.tobytes()], "lengths": [lengths.tobytes()], "symbols": [symbols.tobytes()],
        }
        names, held, block, before, size = [], [], block + 1, before + size, 0
        return pa.RecordBatch.from_pydict(row, _ARROW)

    for batch in batches:
        ids_of = batch.column("doc_id").to_pylist()
        for at, text in encoding.slices(batch.column("text")):
            for k, ids in enumerate(enc.encode(text)):
                if held and size + len(ids) + 1 > block_tokens:
                    yield flush()
                names.append(ids_of[at + k])
                held.append(ids.copy())
                size += len(ids) + 1
    if held:
        yield flush()


_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())),
    ("doc_tokens", pa.list_(pa.int32())), ("base", pa.int32()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()),
])


def write_store(docs: DataFrame, to: str, tokenizer: str | None = None, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encodes docs (doc_id, text) and writes the store to the path ``to``."""
    if not docs.columns:
        raise ValueError("docs has no columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _blocks(TaskContext.get().partitionId(), tokenizer or encoding.default_path(), end_id, block_tokens, batches)

    ordered = tables.doc_columns(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    ordered.select("doc_id", "text").mapInArrow(run, STORE_SCHEMA).write.option("compression", "zstd").parquet(to)


def decode_block(row: dict) -> tuple[Grammar, np.ndarray]:
    kind = np.uint16 if row["base"] < (1 << 16) - 1024 else np.uint32
    rules = np.frombuffer(row["rules"], kind).reshape(-1, 2)
    return Grammar(row["base"], rules, np.frombuffer(row["lengths"], np.uint32)), np.frombuffer(row["symbols"], kind)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The store's blocks; before is the number of ids ahead of a block in the whole store."""
    store = spark.read.schema(STORE_SCHEMA).parquet(path)
    # one row for each written part, so no more rows than tasks wrote the store
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    return store.join(F.broadcast(first), "part").withColumn("before", F.col("before") + F.col("first")).drop("first")


_READ = "doc_id long, start long, n_tokens long, ids binary"


def _read_batch(names: list, start: np.ndarray, sizes: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start), pa.array(sizes), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document: ids as little-endian unsigned 32-bit integers, decoded from the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grammar, symbols = decode_block(row)
                ids = grammar.expand(symbols).astype("<u4")
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                yield _read_batch(row["doc_id"], row["before"] + ends - sizes, sizes, [ids[a:b].tobytes() for a, b in zip(ends - sizes, ends)])

    return _numbered(spark, path).drop("part", "block").mapInArrow(run, _READ)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """read_store's rows of the documents in wanted (doc_id): only their blocks are read and only their symbols expanded."""
    names = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    listed = spark.read.schema(STORE_SCHEMA).parquet(path).select("part", "block", F.posexplode("doc_id").alias("at", "doc_id"))
    met = listed.join(names, listed["doc_id"].eqNullSafe(names["doc_id"]), "left_semi").groupBy("part", "block").agg(F.sort_array(F.collect_list("at")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(*decode_block(row))
                at = np.array(row["at"], np.int64)
                sizes = np.array(row["doc_tokens"], np.int64)
                start = np.cumsum(sizes) - sizes
                ids = [block.decode_range(int(start[k]), int(sizes[k])).astype("<u4").tobytes() for k in at]
                yield _read_batch([row["doc_id"][k] for k in at], row["before"] + start[at], sizes[at], ids)

    return _numbered(spark, path).join(met, ["part", "block"]).drop("part", "block").mapInArrow(run, _READ)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.new_path(spark, "tokens")
    write_store(tables.read(spark, sf_dir, "documents"), path)
    tables.release(spark)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
