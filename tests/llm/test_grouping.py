"""Centroid clustering, SentencePiece, spelling variants: against brute force and the library."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import centroids, pieces, spelling, tables

from .helpers import base_rows, frame, lower


def clustered(rows, k, rounds):
    """The clustering with Python integers and all distances."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, int(np.floor(256 * np.float64(x))))) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    cs = [v for _, v in order[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    to = lambda v: min((d(v, c), i) for i, c in enumerate(cs))
    for _ in range(rounds):
        which = [to(v)[1] for _, v in kept]
        for i in range(len(cs)):
            mine = [v for (_, v), c in zip(kept, which) if c == i]
            if mine:
                cs[i] = [sum(x) // len(mine) for x in zip(*mine)]
    told = [(i, *to(v)) for i, v in kept]
    inertia = lambda c: sum(x for _, x, y in told if c in (None, y))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, c, x, inertia(c), inertia(None), sha[c]) for i, x, c in told), key=str)


@pytest.mark.parametrize("kind", ["spread", "ties", "large"])
def test_clusters(spark, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=(70, 6)), "ties": rng.integers(0, 3, size=(90, 6)) / 256, "large": rng.normal(size=(40, 6)) * 1e6}[kind]
    good = [(i, v.tolist()) for i, v in enumerate(x)]
    good += good[:5] + [(None, [0.5] * 6)]
    bad = [(300, None), (301, [0.0] * 5), (302, [None] + [0.0] * 5), (303, [float("nan")] * 6), (304, [float("-inf")] + [0.0] * 5), (305, [])]
    rows = spark.createDataFrame([(i, v) for i, v in good + bad], "vec_id long, n array<double>").repartition(5)
    got = sorted((tuple(r) for r in centroids.cluster(rows, 7, 3, size=6).collect()), key=str)
    assert got == clustered(good, 7, 3)


def test_clusters_of_few_and_none(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, v array<float>")
    got = centroids.cluster(rows, 5, 2, size=2).orderBy("vec_id").collect()
    assert [r.distance for r in got] == [0, 0] and len({r.cluster for r in got}) == 2
    none = centroids.cluster(rows.limit(0), size=2)
    assert none.count() == 0 and none.columns == got[0].__fields__


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from([1, 50, 1 << 27]))
def test_screening_is_exact(seed, scale):
    rng = np.random.default_rng(seed)
    v, c = (np.clip(rng.integers(-3, 4, size=(n, 9)) * scale, -(1 << 27), 1 << 27) for n in (40, 12))
    which, best, made = centroids.nearest(v, centroids.block_norms(v), c)
    d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and len(v) <= made <= d.size


def test_screening_prunes():
    rng = np.random.default_rng(0)
    c = rng.integers(0, 2, size=(40, 64)) * rng.integers(100, 4000, size=(40, 1))
    v = c[rng.integers(0, 40, size=500)] + rng.integers(-9, 10, size=(500, 64))
    assert centroids.nearest(v, centroids.block_norms(v), c)[2] < 500 * 20


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(pieces.default_path("piece_bpe_32k.model"))


def packed(table, dtype):
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pieces.Table(sink.getvalue().to_pybytes(), dtype)


def table_of(model, chunks):
    return packed(pa.table({"chunk": pa.array(chunks, pa.string()), "ids": pa.array([x.tobytes() for x in model.segment(chunks)], pa.binary())}), model.dtype)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text("ab 1\n▁é.<s>\U0001f600")), max_size=6), st.booleans())
def test_pieces_equal_the_library(texts, known):
    m = pieces.pieces(pieces.default_path("piece_bpe_32k.model"))
    assert m.by_chunk
    texts = [None if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    column = pa.array(texts, pa.string())
    chunks = sorted(set(m.cut(column)[1].to_pylist())) if known else []
    ids, ends = pieces.encode_slice(m, table_of(m, chunks[::2]), column)
    got = [x.tolist() for x in np.split(ids, ends)[:-1]]
    assert got == [m.model.encode(t or "") for t in texts]
    framed = [[1, *x, 2] for x in got]
    assert [x.decode() for x in m.decode(np.array(sum(framed, []), np.int64), np.cumsum([len(x) for x in framed]))] == [m.model.decode(x) for x in framed]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(29800, 29999)), max_size=8), min_size=1, max_size=4))
def test_any_ids_decode_as_in_the_library(runs):
    m = pieces.pieces(pieces.default_path("piece_bpe_32k.model"))
    got = m.decode(np.array(sum(runs, []), np.int64), np.cumsum([len(x) for x in runs]))
    assert [x.decode() for x in got] == [m.model.decode(x) for x in runs]


@pytest.mark.parametrize("most", [pieces.TABLE_BYTES, 3000, 0])
def test_piece_digests(spark, model, most):
    rows = base_rows() + [(i, t, None, None, 0, "", "", 0, "", "") for i, t in ((20, "no-blank-" * 4000), (21, " " * 300), (22, "a\n\n  b " * 50))]
    got = sorted((tuple(r) for r in pieces.encode(frame(spark, rows), keep=True, most_bytes=most).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = [1, *model.model.encode(t or ""), 2]
        shown = model.model.decode(ids)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest(), ids, shown))
    assert got == sorted(want, key=str)
    back = pieces.decode(spark.createDataFrame([(r[0], r[4]) for r in got] + [(99, None)], "doc_id long, ids array<int>")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted([(r[0] or -1, r[5]) for r in got] + [(99, "")])


def test_the_table_holds_each_frequent_chunk_once(spark, model):
    rows = [(i, t, None, None, 0, "", "", 0, "", "") for i, t in enumerate(["the cat the dog", "the dog 42\nthe end", "x" * 500 + " dog"])]
    docs = tables.doc_columns(frame(spark, rows))
    table = pieces.chunk_table(docs, pieces.default_path("piece_bpe_32k.model"))
    rows = dict(zip(table["chunk"].to_pylist(), table["ids"].to_pylist()))
    assert len(rows) == len(table) and sorted(rows) == [" dog", " the"]
    assert all(np.frombuffer(b, model.dtype).tolist() == model.model.encode(c[1:]) for c, b in rows.items())


def test_pieces_of_nothing(spark):
    assert pieces.encode(frame(spark, [])).count() == 0


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    cuts = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return b in cuts(a) or a in cuts(b)


def told_by_pairs(counts):
    form, out = {}, []
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
        out.append([w, n, len(close), form[w], counts[form[w]] if form[w] else None])
    for r in out:
        at = r[0]
        while form[at]:
            at = form[at]
        r.append(at)
    return sorted(map(tuple, out))


def test_near_words_and_roots(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.choice([5, 5, 6, 7, 8, 31, 32, 33, 34]))): 3 << rnd.randrange(12) for _ in range(500)}
    for w in list(words)[::3]:
        i = rnd.randrange(len(w))
        words[rnd.choice([w[:i] + w[i + 1 :] if len(w) > 5 else w, w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1 :]])] = 3 << rnd.randrange(12)
    words |= {"x" * 3000: 9, "x" * 3001: 4, "x" * 2999 + "y": 30, "ab\x00cd": 3, "日本語日本": 5, "日本語日本語": 11}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    want = told_by_pairs(words)
    assert sum(r[2] for r in want) > 300 and sum(r[5] not in (r[0], r[3]) for r in want) > 20
    assert sorted(map(tuple, spelling.variants(rows).collect())) == want
    many = spelling.near_words(rows, shard_bytes=3000)
    assert sorted((r.word, r.n_near) for r in many.collect()) == [(r[0], r[2]) for r in want if r[2]]


def test_words_of_texts(spark):
    texts = ["Straße STRASSE Ärger ärger", "hello Hello HELLO helo hellO_world", None, "", "KKelvin abc×def÷ghi", "word" * 3000, "é" * 5 + " 12 abcde,abcde"]
    rows = [(i if i != 2 else None, t, None, None, 0, "", "", 0, "", "") for i, t in enumerate(texts * 40)]
    counts: dict = {}
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                counts[w] = counts.get(w, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    assert sorted(map(tuple, spelling.group(frame(spark, rows)).collect())) == told_by_pairs(counts)


def test_spelling_of_nothing(spark):
    assert spelling.group(frame(spark, [])).count() == 0
