"""Packing (operator 5): bounded-space online best-fit packing into fixed windows.

Each input partition packs its documents in one pass with at most ``open_windows`` open
windows. A document of a window or more gives whole windows first; what remains goes to
the open window that it fits best. If it fits none, the fullest window is emitted (when
its gap is at least ``cut_gap``, the head of the document fills it first) and a new one
is opened. What a partition leaves open is merged afterwards: ``fan_in`` neighbouring
partitions at a time pack their left-over pieces again, largest first, round by round,
until one group is left, which also closes the gaps of its own windows by cutting. So
no task ever holds more than ``fan_in * open_windows`` windows.

Defined cases: a null text is empty and yields a piece with the end id alone; equal
doc_ids and null doc_ids are packed like any other rows; an empty table yields no
piece; other columns are ignored. Sequence numbers are unique, not consecutive.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, tables, workers

WINDOW = 4096
OPEN_WINDOWS = 64
FAN_IN = 16
CUT_GAP = 48
_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("open", pa.bool_()),
]
_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, part int, open boolean"


class Piece:
    """Part of a document; its parts can be cut again."""

    __slots__ = ("doc_id", "doc_tokens", "ids", "start")

    def __init__(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray):
        self.doc_id, self.start, self.doc_tokens, self.ids = doc_id, start, doc_tokens, ids

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:at]), Piece(self.doc_id, self.start + at, self.doc_tokens, self.ids[at:])


class Packer:
    """Bounded-space best fit. place() returns the windows that it emits."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, cut_gap: int = CUT_GAP):
        self.window, self.most, self.cut_gap = window, open_windows, cut_gap
        self.gaps: list[tuple[int, int]] = []  # (free ids, number) of each open window, ascending
        self.open: dict[int, list[Piece]] = {}
        self.made = 0

    def place(self, piece: Piece) -> list[list[Piece]]:
        out = []
        while len(piece.ids) >= self.window:
            head, piece = piece.cut(self.window)
            out.append([head])
        while len(piece.ids):
            size = len(piece.ids)
            at = bisect_left(self.gaps, (size, -1))
            if at < len(self.gaps):
                gap, number = self.gaps.pop(at)
            elif len(self.gaps) < self.most:
                gap, number = self.window, self.made
                self.made += 1
                self.open[number] = []
            else:
                gap, number = self.gaps.pop(0)
                full = self.open.pop(number)
                if gap >= self.cut_gap:
                    head, piece = piece.cut(gap)
                    full.append(head)
                out.append(full)
                continue
            self.open[number].append(piece)
            if gap == size:
                out.append(self.open.pop(number))
            else:
                insort(self.gaps, (gap - size, number))
            break
        return out

    def rest(self) -> list[list[Piece]]:
        """The open windows, the fullest first."""
        return [self.open[number] for _, number in self.gaps]

    def tighten(self) -> list[list[Piece]]:
        """The open windows, after the emptiest have given their pieces, cut, to the gaps of the others."""
        windows, gaps = self.rest(), [gap for gap, _ in self.gaps]
        to = 0
        while to < len(windows) - 1:
            if not gaps[to]:
                to += 1
                continue
            piece = windows[-1].pop()
            if len(piece.ids) > gaps[to]:
                piece, tail = piece.cut(gaps[to])
                windows[-1].append(tail)
            windows[to].append(piece)
            gaps[to] -= len(piece.ids)
            gaps[-1] += len(piece.ids)
            if not windows[-1]:
                windows.pop()
                gaps.pop()
        return windows


class _Rows:
    """Arrow batches of pieces, of bounded size."""

    def __init__(self, part: int, level: int):
        self.part, self.base, self.made, self.rows, self.size = part, (level << 56) | (part << 32), 0, [], 0

    def add(self, window: list[Piece], still_open: bool = False) -> None:
        at = 0
        for p in window:
            self.rows.append((p.doc_id, p.start, len(p.ids), p.doc_tokens, self.base | self.made, at, p.ids.astype("<u4").tobytes(), self.part, still_open))
            at += len(p.ids)
        self.made += 1
        self.size += at

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*self.rows), _FIELDS)], [n for n, _ in _FIELDS])
            self.rows, self.size = [], 0


def pack(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN, cut_gap: int = CUT_GAP,
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of docs (doc_id, text)."""
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoding.encoder(tokenizer or encoding.default_path())
        packer, rows, end = Packer(window, open_windows, cut_gap), _Rows(TaskContext.get().partitionId(), 0), np.array([end_id], enc.dtype)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for at, text in encoding.slices(batch.column("text")):
                for k, ids in enumerate(enc.encode(text)):
                    # a copy, so that a small rest doesn't hold the whole slice in memory
                    for full in packer.place(Piece(names[at + k], 0, len(ids) + 1, np.concatenate([ids, end]))):
                        rows.add(full)
                    yield from rows.batches(1 << 20)
        for full in packer.rest():
            rows.add(full, True)
        yield from rows.batches()
        workers.trim()

    def merge(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces: list[Piece] = []
            group = 0
            for batch in batches:
                for r in batch.to_pylist():
                    group = r["grp"]
                    pieces.append(Piece(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")))
            # the order is total, so a task that runs again does the same
            pieces.sort(key=lambda p: (-len(p.ids), p.doc_id is None, p.doc_id or 0, p.start, p.ids.tobytes()))
            packer, rows = Packer(window, open_windows, cut_gap), _Rows(group, level)
            for piece in pieces:
                for full in packer.place(piece):
                    rows.add(full)
            for full in packer.tighten() if last else packer.rest():
                rows.add(full, not last)
            yield from rows.batches()

        return run

    with tables.small_batches(spark, 4000):
        made = [tables.store(tables.doc_columns(docs).mapInArrow(first, _SCHEMA), "packed")]
    parts = max(1, (made[0].agg(F.max("part")).first()[0] or 0) + 1)
    level = 0
    while True:
        level, groups = level + 1, -(-parts // fan_in)
        left = made[-1].where("open").withColumn("grp", F.floor(F.col("part") / fan_in).cast("int"))
        packed = left.groupBy("grp").applyInArrow(_grouped(merge(level, groups == 1)), _SCHEMA)
        made.append(tables.store(packed, "packed"))
        parts = groups
        if groups == 1:
            break
    out = made[0].where("not open")
    for table in made[1:]:
        out = out.unionByName(table.where("not open"))
    return out.drop("part", "open")


def _grouped(run):
    """run() as a function of a group's batches, given as an iterator or as a table."""

    def call(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(group)

    return call


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(tables.read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
