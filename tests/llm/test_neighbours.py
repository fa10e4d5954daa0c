"""Nearest neighbours and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import encoding, neighbours, tables

from .helpers import deduped, frame, jaccard_components, prose


def brute(rows, queries, k):
    """The k largest inner products of each query, ties to the smaller id."""
    size = max(len(v) for _, v in rows)
    x = {i: np.pad(np.array(v, float), (0, size - len(v))) for i, v in rows}
    out = {}
    for q in queries:
        s = sorted(((-float(x[q] @ x[i]), i) for i in x if i != q))
        out[q] = [i for _, i in s[:k]]
    return out


def test_small_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=6).round(3).tolist()) for i in range(90)]
    good += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(200, [3.0, 1.0])]
    bad = [(300, None), (301, [0.0] * 6), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (305, [])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in good + bad + good[:5]], "vec_id long, v array<double>, node string")
    got: dict = {}
    for r in neighbours.nearest(docs.select("vec_id", "v"), docs.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(good, [i for i, _ in good if i % 20 == 0], 20)
    assert got == want


def test_few_and_none(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, v array<float>")
    assert [tuple(r) for r in neighbours.nearest(docs, docs, 20).orderBy("query_id").collect()] == [(0, 1, 1, 0.5), (1, 1, 0, 0.5)]
    assert neighbours.nearest(docs.limit(0), docs.limit(0)).count() == 0


def test_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    hits = sum(r.vec_id in want[r.query_id] for r in neighbours.op10_nn_descent(spark, sf).collect())
    assert hits >= 0.9 * sum(map(len, want.values()))


def found(spark, tmp_path, x, rounds=None):
    """Share of the true 20 neighbours that are found."""
    ids = range(len(x))
    spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, v array<double>").write.mode("overwrite").parquet(str(tmp_path / "v"))
    docs = spark.read.parquet(str(tmp_path / "v"))
    want = brute(list(zip(ids, x)), [i for i in ids if i % 20 == 0], 20)
    hits = sum(r.vec_id in want[r.query_id] for r in neighbours.nearest(docs, docs.where("vec_id % 20 = 0"), 20).collect())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("scale", ["tiny", "huge", "outliers and norms"])
def test_recall_over_many_leaves(spark, tmp_path, scale):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 24)) + 2 * rng.normal(size=(25, 24))[np.arange(1500) % 25]
    if scale == "outliers and norms":
        x *= np.exp(rng.normal(size=len(x)))[:, None]
        x[[3, 1234]] *= [[1e6], [1e3]]
    assert found(spark, tmp_path, x * {"tiny": 1e-100, "huge": 1e150}.get(scale, 1)) >= 0.95


def test_the_rounds_find_the_neighbours(spark, tmp_path):
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 32)))], "vec_id long, v array<double>")
    base, _, _, named, size = neighbours.nodes(docs, 21)
    x = {r.node: np.array(r.v) / np.linalg.norm(r.v) for r in named.collect()}
    shares = []
    for rounds in (0, None):
        graph = neighbours.build_graph(base, len(x), size, k=16, reverse=16, rounds=rounds).collect()
        assert all(r.node not in r.others and len(set(r.others)) == len(r.others) == len(r.scores) <= 16 and r.scores == sorted(r.scores, reverse=True) for r in graph)
        shares.append(np.mean([r.scores[0] for r in graph]))
    assert shares[1] > shares[0]


def test_many_equal_vectors(spark):
    docs = spark.createDataFrame([(i, [1.0, 0.5] if i % 3 else [float(i), 1.0]) for i in range(900)], "vec_id long, v array<double>")
    rows = neighbours.nearest(docs, docs.where("vec_id % 20 = 0")).collect()
    want = brute([(r.vec_id, r.v) for r in docs.collect()], range(0, 900, 20), 20)
    assert sum(r.vec_id in want[r.query_id] for r in rows) >= 0.95 * 20 * 45 and len(rows) == 20 * 45


def test_pipeline_stages(spark, sf):
    docs = tables.read(spark, sf, "documents")
    n, kept = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = tables.store(stage(spark, kept, sf), "t")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= n, name
        n, kept = out.count(), out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == n


def test_pipeline_on_nothing_and_odd_rows(spark, sf):
    for rows in ([], None):
        docs = tables.pick(frame(spark, rows), "doc_id", "text", "lang", "source", "n_chars")
        before = {r.doc_id for r in docs.collect()}
        for _, stage in corpus_pipeline.STAGES:
            docs = tables.store(stage(spark, docs, sf), "t")
        after = {r.doc_id for r in docs.collect()}
        # texts without a letter and copies go; of the others mixing takes its share
        assert after <= before and not after & {1, 2, 3, 8, 15} and bool(after) == (rows is None)


def test_pipeline_equals_brute_force_where_its_stages_decide(spark, tmp_path):
    """Which documents and texts each stage keeps, by the definitions; the pieces hold the ids of what mixing kept, once each."""
    names = ["the old press of the far north", "a page about cold rivers and tall hills", "All rights reserved.", "    indented once"]
    rows = []
    for i in range(40):
        own = prose(100 + i, 60)
        text = "\n".join([own, names[i % 3], f"Printed on the {i} of May by the old press of the town"] if i % 2 else [own])
        rows.append((i, text, "en", "rare" if i == 7 else f"s{i % 2}", 0))
    rows += [(60, prose(100, 60) + " tail", "en", "s0", 0), (61, prose(103, 60) + " other end", "en", "s1", 0), (62, "12 34", "en", "s0", 0), (63, None, None, None, 0)]
    rows += [(64, "def f():\n    alpha", "en", "s0", 0), (65, "def g():\n    beta", "en", "s0", 0), rows[3], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    pair = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    docs = tables.read(spark, str(tmp_path), "documents")
    stages = [f for _, f in corpus_pipeline.STAGES]
    told = tables.store(stages[0](spark, docs, str(tmp_path)), "stage")
    want = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    assert pair(told) == sorted(want)
    deduped_ = tables.store(stages[1](spark, told, str(tmp_path)), "stage")
    want = [(i, t) for i, t in deduped(want) if t.strip(" ")]
    assert pair(deduped_) == sorted(want)
    apart = tables.store(stages[2](spark, deduped_, str(tmp_path)), "stage")
    want = sorted({(i, t) for (i, t), (_, n, c) in zip(want, jaccard_components(want)) if not n or c is None or c == i})
    assert pair(apart) == want and not {60, 61} & {i for i, _ in want}
    mixed = tables.store(stages[3](spark, apart, str(tmp_path)), "stage")
    assert mixed.columns == docs.columns and set(pair(mixed)) <= set(want) and mixed.count() > len(want) / 4
    enc = encoding.encoder(encoding.default_path())
    got: dict = {}
    for r in stages[4](spark, mixed, str(tmp_path)).orderBy("doc_id", "start").collect():
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    ids = {i: np.array([*enc.model.encode(t, add_special_tokens=False).ids, 2]) for i, t in pair(mixed)}
    assert {i: len(b) // 4 for i, b in got.items()} == {i: len(x) for i, x in ids.items()} and all(np.frombuffer(b, "<u4").tolist() == ids[i].tolist() for i, b in got.items())
