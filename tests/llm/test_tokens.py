"""Token store, packing, token counts: against the tokenizer itself."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import encoding, packing, tables, token_counts, token_store

from .helpers import base_rows, frame


@pytest.fixture(scope="module")
def enc():
    return encoding.encoder(encoding.default_path())


def ids_of(enc, text):
    return np.array([*enc.model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_encoder_equals_the_model(texts):
    e = encoding.encoder(encoding.default_path())
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert [x.tolist() for x in e.encode(pa.array(texts, pa.string()))] == [e.model.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(0, 3))
def test_grammar_round_trip(ids, rounds):
    ids = np.array(ids * 9, np.uint16)
    rules, lengths, symbols = token_store.compress(ids, 7, rounds, 4)
    g = token_store.Grammar(7, rules, lengths)
    assert (g.expand(symbols) == ids).all()
    for a, n in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (0, 0)):
        assert (token_store.Block(g, symbols).decode_range(a, n) == ids[a : a + n]).all()
    if len(ids) > 200 and rounds:
        assert len(symbols) < len(ids)


@pytest.mark.parametrize("base", [500, 90000])
def test_grammar_is_complete(base):
    ids = np.tile(np.arange(500, dtype=np.uint32), 4)
    rules, lengths, symbols = token_store.compress(ids, base)
    assert (token_store.Grammar(base, rules, lengths).expand(symbols) == ids).all() and lengths.max() > 400
    pairs = list(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
    assert len(symbols) < 20 and len(set(pairs)) == len(pairs)


def test_wide_symbols():
    ids = np.array([70000, 80000, 70000, 80000] * 50, np.uint32)
    rules, lengths, symbols = token_store.compress(ids, 90000)
    assert (token_store.Grammar(90000, rules, lengths).expand(symbols) == ids).all() and len(symbols) < len(ids)


def test_store(spark, enc):
    path = tables.new_path(spark, "t")
    token_store.write_store(frame(spark), path, block_tokens=500)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((x[0] for x in base_rows()), key=lambda i: -1 if i is None else i)
    want = sorted((zlib.crc32(ids_of(enc, x[1]).tobytes()), x[0] or -1) for x in base_rows())
    assert sorted((zlib.crc32(bytes(r.ids)), r.doc_id or -1) for r in got) == want


def test_documents_are_read_alone(spark):
    path = tables.new_path(spark, "t")
    token_store.write_store(frame(spark), path, block_tokens=500)
    key = lambda r: (r.start, r.doc_id, r.n_tokens, bytes(r.ids))
    for some in ([7, 12, None], [99], []):
        wanted = spark.createDataFrame([(i,) for i in some], "doc_id long")
        want = sorted(key(r) for r in token_store.read_store(spark, path).collect() if r.doc_id in some)
        assert sorted(key(r) for r in token_store.read_documents(spark, path, wanted).collect()) == want


def test_store_of_nothing(spark):
    path = tables.new_path(spark, "t")
    token_store.write_store(frame(spark, []), path)
    assert token_store.read_store(spark, path).count() == 0


@pytest.mark.parametrize("windows, parts", [(2, 1), (3, 40)])
def test_packing(spark, enc, windows, parts):
    got = packing.pack(frame(spark).repartition(parts), window=64, open_windows=windows, fan_in=3, cut_gap=4).collect()
    by_seq: dict = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.length * 4 == len(r.ids) and r.length > 0
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))] and sum(r.length for r in rows) <= 64
    total = sum(len(ids_of(enc, x[1])) for x in base_rows())
    assert sum(r.length for r in got) == total and len(by_seq) <= total / 64 * 1.1 + 2
    whole = sorted(ids_of(enc, x[1]).tobytes() for x in base_rows() if x[0] not in (12, 14, None))
    docs: dict = {}
    for r in sorted(got, key=lambda r: r.start):
        if r.doc_id not in (12, 14, None):
            docs[r.doc_id] = docs.get(r.doc_id, b"") + bytes(r.ids)
    assert sorted(docs.values()) == whole


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_token_counts(spark, enc):
    sizes = np.array([len(ids_of(enc, x[1])) for x in base_rows()])
    sums = token_counts.suffix_sums(token_counts.length_histogram(frame(spark), end_id=2))
    for r in sums.collect():
        n = r.length
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_total) == ((sizes == n).sum(), (sizes >= n).sum(), sizes[sizes >= n].sum(), np.minimum(sizes, n).sum())
    assert token_counts.total(sums).first() == (len(sizes), sizes.sum())
    for q in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(sums, q).first()[0] == np.sort(sizes)[int(np.ceil(q * len(sizes))) - 1]
    for limit in (1, 10, 777):
        assert token_counts.truncated_total(sums, limit).first()[0] == np.minimum(sizes, limit).sum()


def test_token_counts_of_nothing(spark):
    sums = token_counts.suffix_sums(token_counts.length_histogram(frame(spark, [])))
    assert sums.count() == 0 and token_counts.total(sums).first() == (0, 0)
