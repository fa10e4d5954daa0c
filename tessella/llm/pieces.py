"""SentencePiece encoding and decoding (operator 12): a table of distinct chunks.

A text becomes a chain of chunks: its blanks are the model's markers, a marker goes before it, and a
chunk ends where a run of markers begins and around each character that no longer piece holds (line
feeds and digits, in the public model). If no piece crosses such a place, which is read from the
vocabulary when the model is loaded, segmenting the chunks apart gives the ids of the whole text.

* The chunks of the whole corpus are counted, summed up in each slice of texts first.
* Those that occur most often are segmented once each, by Spark, and make the table: as many powers of
  two of the count as ``TABLE_BYTES`` holds, so its size is proven before it is sent to the workers.
* Then each slice of texts finds its distinct chunks in the table and puts the ids together by position.
  A chunk that the table doesn't hold (rarer than its least count, or longer than ``LONGEST`` bytes) is
  segmented once a slice where it stands: to shuffle it would mean to shuffle all texts with it.

Decoding gathers the bytes of the pieces by position; ids that no text encodes to (cut byte runs, no
marker in front) go through the library's own decode. A model whose pieces cross blanks, or that
normalises its input, is applied to whole texts.

Defined cases: a null text is an empty one and has the begin and the end id only; U+2581 in a text is a
marker as a blank is; repeated rows give repeated rows; a null doc_id stays null; an empty table
stays empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables, workers
from .encoding import default_path, slices

#: Longer chunks aren't counted and aren't in the table.
LONGEST = 64
#: Most bytes of the table: a chunk of b bytes has at most b ids of two or four bytes, and its places.
TABLE_BYTES = 48 << 20
MARK = "▁"

_PROBES = ["Plain words, 12 more.\nA  second\tline  ", " <s> x</s> don't ?! été straße ﬁ ① 　", "\n\n9.9 a▁b", ""]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of these sizes from these starts, one run after the other."""
    kind = np.int32 if sizes.sum() < 1 << 31 and (len(starts) == 0 or starts.max() < 1 << 31) else np.int64
    ends = np.cumsum(sizes, dtype=kind)
    out = np.repeat(starts.astype(kind) - (ends - sizes.astype(kind)), sizes)
    out += np.arange(len(out), dtype=kind)
    return out


class Pieces:
    """A SentencePiece model: cutting, segmenting, decoding."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        self.dtype = np.dtype("<u2") if len(every) <= 1 << 16 else np.dtype("<u4")
        plain = [p for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)) for p in [m.id_to_piece(i)]]
        joined = set("".join(p for p in plain if len(p) > 1)) | {" "}
        self._alone = np.array([b < 128 and chr(b) not in joined for b in range(256)])
        crossing = any(MARK in p.lstrip(MARK) for p in plain) or not self._alone[10]
        shown = [b"" if m.is_control(i) else bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in every]
        self._bytes = np.frombuffer(b"".join(shown), np.uint8)
        self._size = np.array([len(x) for x in shown], np.int32)
        self._start = np.cumsum(self._size) - self._size
        self._marked = np.array([m.id_to_piece(i).startswith(MARK) for i in every])
        self._control = np.array([m.is_control(i) for i in every])
        self._unknown = np.array([m.is_unknown(i) for i in every])
        self.by_chunk = False
        self.by_chunk = not crossing and self._same(_PROBES)

    def _same(self, texts: list[str]) -> bool:
        """Whether cutting gives the ids of the whole texts."""
        _, chunks, rows = self.cut(pa.array(texts))
        ids = iter(self.segment(chunks.to_pylist()))
        return [[x for _ in range(n) for x in next(ids).tolist()] for n in rows] == [self.model.encode(t) for t in texts]

    def cut(self, column: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(marked texts, their chunks, number of chunks of each text); the chunks lie in the texts' own memory."""
        column = pc.replace_substring(pc.fill_null(column, "").cast(pa.string()), MARK, " ")
        column = pc.if_else(pc.greater(pc.binary_length(column), 0), pc.binary_join_element_wise(" ", column, ""), column)
        if not len(column):
            return column, pa.array([], pa.string()), np.zeros(0, np.int64)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        if ends[-1] == ends[0]:
            return column, pa.array([], pa.string()), np.zeros(len(column), np.int64)
        text = np.frombuffer(data, np.uint8)[: ends[-1]]
        cut = np.zeros(len(text) + 1, bool)
        blank = text == 32
        cut[1:-1] = blank[1:] & ~blank[:-1]
        alone = self._alone[text]
        cut[:-1] |= alone
        cut[1:] |= alone
        cut[ends] = True
        cut[: ends[0]] = False
        at = np.flatnonzero(cut).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), data)
        return column, chunks, np.diff(np.searchsorted(at, ends))

    def segment(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk. A line feed goes before it, which no piece crosses: the ids after the marker's and its own are the chunk's."""
        return [np.array(x[2:], self.dtype) for x in self.model.encode(["\n" + c for c in chunks], num_threads=1)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each run of ids, as the library's decode gives them."""
        sizes = self._size[ids]
        data = self._bytes[_places(self._start[ids], sizes)].tobytes()
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        out = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            shown = data[total[a] : total[b]]
            first = a
            while first < b and self._control[ids[first]]:
                first += 1
            # else a marker that is no blank in front, or byte runs that a control id cuts
            if not self._unknown[ids[first:b]].any() and (first == b or self._marked[ids[first]] and not self._control[ids[first : b - 1]].any()):
                try:
                    shown.decode()
                    out.append(shown[1:])
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(self.model.decode(ids[a:b].tolist()).encode())
        return out


def pieces(path: str) -> Pieces:
    """One model for each worker process, as long as it is in use."""
    return workers.only(("pieces", path), lambda: Pieces(path))


def _count_slices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        for _, part in slices(batch.column(0), 16 << 20):
            _, chunks, _ = model.cut(part)
            counted = pc.value_counts(chunks)
            chunk, n = counted.field(0), counted.field(1)
            fits = pc.less_equal(pc.binary_length(chunk), LONGEST)
            yield pa.RecordBatch.from_arrays([chunk.filter(fits), n.filter(fits)], ["chunk", "n"])
    workers.trim()


def chunk_counts(docs: DataFrame, path: str) -> DataFrame:
    """(chunk, n) of the chunks of at most LONGEST bytes that occur more than once in all texts."""
    each = docs.select("text").mapInArrow(partial(_count_slices, path=path), "chunk string, n long")
    return each.groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")


def _segment_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        chunk = batch.column(0)
        yield pa.RecordBatch.from_arrays([chunk, pa.array([x.tobytes() for x in model.segment(chunk.to_pylist())], pa.binary())], ["chunk", "ids"])


def least_count(counts: DataFrame, most_bytes: int = TABLE_BYTES) -> int | None:
    """The smallest power of two such that all chunks of at least that count fit the table; None if not even the most frequent do."""
    weight = F.sum(F.octet_length("chunk") * 5 + 16)
    by_power = {r["p"]: r["b"] for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(weight.alias("b")).collect()}
    least, total = None, 0
    for p in sorted(by_power, reverse=True):
        total += by_power[p]
        if total > most_bytes:
            break
        least = 1 << p
    return least


def chunk_table(docs: DataFrame, path: str, most_bytes: int = TABLE_BYTES) -> pa.Table:
    """(chunk, ids) of the most frequent chunks, each segmented once; at most most_bytes."""
    with tables.scratch():
        counts = tables.store(chunk_counts(docs, path), "chunks")
        least = least_count(counts, most_bytes)
        if least is None:
            return pa.table({"chunk": pa.array([], pa.string()), "ids": pa.array([], pa.binary())})
        often = counts.where(F.col("n") >= least).select("chunk")
        segmented = tables.store(often.mapInArrow(partial(_segment_rows, path=path), "chunk string, ids binary"), "segments")
        return segmented.toArrow()


class Table:
    """The chunk table as a worker holds it."""

    def __init__(self, data: bytes, dtype: np.dtype):
        rows = pa.ipc.open_stream(data).read_all().combine_chunks()
        one = lambda c, kind: c.combine_chunks().cast(kind) if isinstance(c, pa.ChunkedArray) else c.cast(kind)
        self.chunks = one(rows["chunk"], pa.string())
        ids = one(rows["ids"], pa.binary())
        self.ends = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1] // dtype.itemsize if len(ids) else np.zeros(1, np.int32)
        self.ids = np.frombuffer(ids.buffers()[2] or b"", dtype)


def encode_slice(model: Pieces, table: Table, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in turn, without begin and end, and where each text ends."""
    if not model.by_chunk:
        each = [np.array(x, model.dtype) for x in model.model.encode(pc.fill_null(column, "").to_pylist(), num_threads=1)]
        return np.concatenate([np.zeros(0, model.dtype), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)
    _, chunks, rows = model.cut(column)
    coded = chunks.dictionary_encode()
    found = pc.index_in(coded.dictionary, table.chunks)
    missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
    new = model.segment(coded.dictionary.take(pa.array(missing)).to_pylist())
    # the slice's own ids lie behind the table's
    ids = np.concatenate([table.ids, *new])
    at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)
    start, size = (table.ends[at], table.ends[at + 1] - table.ends[at]) if len(table.chunks) else (np.zeros(len(at), np.int64),) * 2
    start, size = start.astype(np.int64), size.astype(np.int64)
    size[missing] = [len(x) for x in new]
    start[missing] = len(table.ids) + np.cumsum(size[missing]) - size[missing]
    places = coded.indices.to_numpy(zero_copy_only=False)
    sizes = size[places]
    total = np.concatenate([[0], np.cumsum(sizes)])
    return ids[_places(start[places], sizes)], total[np.cumsum(rows)]


def _encode_rows(batches: Iterator[pa.RecordBatch], path: str, table, keep: bool) -> Iterator[pa.RecordBatch]:
    model, held = pieces(path), None
    for batch in batches:
        held = held or Table(table.value, model.dtype)
        begin, end = (np.array([i], "<u4") for i in (model.model.bos_id(), model.model.eos_id()))
        for at, part in slices(batch.column(1)):
            ids, ends = encode_slice(model, held, part)
            framed = [np.concatenate([begin, x, end]) for x in np.split(ids.astype("<u4"), ends[:-1])]
            decoded = model.decode(np.concatenate(framed), np.cumsum([len(x) for x in framed]))
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            columns = [batch.column(0).slice(at, len(part)), pa.array([len(x) for x in framed], pa.int64()), sha(framed), sha(decoded)]
            if keep:
                columns += [pa.array([x.tolist() for x in framed], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, NAMES + MORE if keep else NAMES)
    workers.trim()


NAMES, MORE = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], ["ids", "decoded"]
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str | None = None, keep: bool = False, most_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row a document: number of ids with begin and end, digests of the ids and of the decoded text; both themselves with keep."""
    path = path or default_path("piece_bpe_32k.model")
    docs = tables.doc_columns(docs)
    table = chunk_table(docs, path, most_bytes)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sent = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    return docs.mapInArrow(partial(_encode_rows, path=path, table=sent, keep=keep), SCHEMA + (", ids array<int>, decoded string" if keep else ""))


def _decode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        ids = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
        text = model.decode(np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum([len(x) for x in ids], dtype=np.int64)) if ids else []
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in text], pa.string())], ["doc_id", "text"])


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids are none, null doc_ids stay."""
    path = path or default_path("piece_bpe_32k.model")
    rows = tables.pick(rows, "doc_id", "ids").select(F.col("doc_id").cast("long"), F.filter(F.col("ids").cast("array<int>"), lambda x: x.isNotNull()).alias("ids"))
    return rows.mapInArrow(partial(_decode_rows, path=path), "doc_id long, text string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(tables.read(spark, sf_dir, "documents"))
