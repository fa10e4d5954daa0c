"""The inverted index and the vector index: against brute force, after changes, and what they open."""

import math
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import retrieval
from tessella.sources import ivf, postings, scratch
from tessella.sources.records import records


@pytest.fixture
def place(spark):
    return f"{scratch.checkpoints(spark)}/test-{uuid.uuid4().hex}"


SCHEMA = "profile string, uuid long, content string, summary string, keywords array<string>, topic string, data_id string"


def rows_of(spark, texts):
    return spark.createDataFrame([(p, i, t, None, ["extra"] if i % 2 else None, None, "x") for i, (p, t) in texts.items()], SCHEMA)


def scored(texts, terms):
    """BM25 by the formula."""
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) + (["extra"] if i % 2 else []) + ["x"] for i, (_, t) in texts.items()}
    out = {}
    for p in {p for p, _ in texts.values()}:
        mine = [i for i in texts if texts[i][0] == p]
        mean = sum(len(words[i]) for i in mine) / len(mine)
        for i in mine:
            s = 0.0
            for t in terms:
                nt, f = sum(t in words[j] for j in mine), words[i].count(t)
                idf = max(math.log((len(mine) - nt + 0.5) / (nt + 0.5)), 1e-6)
                s += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
            if any(t in words[i] for t in terms):
                out[p, i] = round(s, 6)
    return out


def told(index, terms):
    return {(r.profile, r.uuid): round(r.score, 6) for r in index.scores(terms).collect()}


def test_postings_follow_changes(spark, place):
    texts = {i: ("ab"[i % 2], t) for i, t in enumerate(["the cat sat", "The dog, the DOG", "cat cat cat dog", None, "", "élan vital", "dog days of the cat"])}
    terms = ["cat", "dog", "the", "the", "élan", "nowhere", "extra"]
    index = postings.Postings(spark, place, buckets=4)
    assert index.write(rows_of(spark, texts), 5) and not index.write(rows_of(spark, texts), 5)
    assert told(index, terms) == pytest.approx(scored(texts, terms))
    new = {1: ("a", "cat of another profile"), 6: ("a", "the"), 20: ("b", "a new dog")}
    index.write(rows_of(spark, new), 6)
    texts |= new
    assert told(index, terms) == pytest.approx(scored(texts, terms))
    # a batch that broke off before its commit doesn't count, and is written anew
    index.commits.write(spark.createDataFrame([(0,), (1,)], "uuid long"), "gone", 7)
    assert told(index, terms) == pytest.approx(scored(texts, terms))
    gone = spark.createDataFrame([(2,), (2,), (99,)], "uuid long")
    assert index.delete(gone, 7) and not index.delete(gone, 7)
    del texts[2]
    assert told(index, terms) == pytest.approx(scored(texts, terms))
    index.write(rows_of(spark, {2: ("b", "the cat is back")}), 8)
    texts[2] = ("b", "the cat is back")
    before = told(index, terms)
    assert before == pytest.approx(scored(texts, terms)) and index.compact(9)
    assert told(index, terms) == before and index.commits.batches() == [9]
    counts = Counter((p, w) for i, (p, t) in texts.items() for w in set(re.findall(r"[^\W_]+", (t or "").lower()) + (["extra"] if i % 2 else []) + ["x"]))
    assert {(r.profile, r.term): r.n_docs for r in index.lexicon().collect()} == counts
    with pytest.raises(ValueError):
        index.write(rows_of(spark, new), 4)
    assert told(index, []) == {} and told(index, ["nowhere"]) == {}


def test_a_query_opens_the_folders_of_its_terms(spark, sf, place):
    rows = records(spark, sf)
    index = postings.Postings(spark, place, buckets=16)
    index.write(rows, 0)
    found = index.postings(["the", "der"])
    files = {f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(f"{place}/postings").inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(files) == 16 and re.search(r"PartitionFilters: \[.*bucket.* IN", plan) and re.search(r"PushedFilters: \[.*term", plan)
    want = retrieval.bm25(rows, ["the", "der", "the"]).where("matched")
    assert {(r.profile, r.uuid): r.score for r in want.collect()} == pytest.approx({(r.profile, r.uuid): r.score for r in index.scores(["the", "der", "the"]).collect()}, abs=2e-9)


def test_index_of_nothing(spark, place):
    index = postings.Postings(spark, place)
    assert told(index, ["a"]) == {}
    index.write(rows_of(spark, {1: ("a", "x")}).limit(0), 0)
    assert told(index, ["a"]) == {} and index.statistics().count() == 0


def clusters(n, size, groups, spread, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, size))
    c /= np.linalg.norm(c, axis=1)[:, None]
    return (c[rng.integers(0, groups, n)] + rng.normal(size=(n, size)) * spread) * rng.uniform(0.1, 9, size=(n, 1))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, "pq"[i % 2], [float(y) for y in v]) for i, v in enumerate(x)], "uuid long, collection string, embedding array<float>")


def best(x, q, k, skip=()):
    u = x.astype("float32").astype(float)
    u = (u / np.linalg.norm(u, axis=1)[:, None]).astype("float32").astype(float)
    s = np.round(u @ (q / np.linalg.norm(q)), 6)
    return sorted(((-s[i], i) for i in range(len(x)) if i not in skip))[:k]


def test_vector_index_is_exact_and_opens_few_lists(spark, place):
    x = clusters(1500, 12, 25, 0.02)
    index = ivf.VectorIndex(spark, place, 12)
    bad = spark.createDataFrame([(9001, "p", None), (9002, "p", [0.0] * 12), (9003, "p", [1.0]), (9004, "p", [float("nan")] * 12)], "uuid long, collection string, embedding array<float>")
    assert index.build(frame(spark, x).union(bad), lists=25) and not index.build(frame(spark, x))
    assert index.rows().count() == 1500
    for q in (x[3], x[700], -x[1]):
        got, lists = index.nearest(q.tolist(), 10)
        rows = got.orderBy("rn").collect()
        assert [r.uuid for r in rows] == [i for _, i in best(x, q, 10)]
    _, lists = index.nearest(x[3].tolist(), 10)
    assert len(lists) < 6
    by = index.nearest(x[3].tolist(), 4, by=True)[0].collect()
    want = {c: [i for _, i in best(x, x[3], 4, skip=[j for j in range(1500) if j % 2 != p])] for p, c in enumerate("pq")}
    assert {c: [r.uuid for r in sorted(by, key=lambda r: r.rn) if r.collection == c] for c in "pq"} == want
    plan = index.nearest(x[3].tolist(), 10, probes=2)[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*list.* IN", plan)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 1500, 100)], "query_id long, q array<float>")
    hits = index.nearest_all(queries, 10, 2).collect()
    assert sum(r.uuid in {i for _, i in best(x, x[r.query_id], 10)} for r in hits) >= 0.9 * 150


def test_vector_index_follows_changes(spark, place):
    x = clusters(300, 8, 5, 0.05, seed=1)
    index = ivf.VectorIndex(spark, place, 8)
    index.build(frame(spark, x), lists=5)
    y = clusters(40, 8, 40, 0.3, seed=2)
    x[:30] = y[:30]
    assert index.write(frame(spark, y[:30]), 1) and not index.write(frame(spark, y), 1)
    assert index.write(spark.createDataFrame([(40, "p", None)], "uuid long, collection string, embedding array<float>"), 2)
    index.delete(spark.createDataFrame([(50,), (777,)], "uuid long"), 3)
    for _ in range(2):
        for q in (x[0], y[35], x[50]):
            got, _ = index.nearest(q.tolist(), 7)
            assert [r.uuid for r in got.orderBy("rn").collect()] == [i for _, i in best(x, q, 7, skip=(40, 50))]
        index.compact(4, lists=7)
    assert index.commits.batches() == [4] and index.rows().count() == 298


def test_a_stream_fills_the_index_once(spark, place, tmp_path):
    x = clusters(60, 8, 3, 0.05)
    index = ivf.VectorIndex(spark, place, 8)
    index.build(frame(spark, x[:20]), lists=3)
    frame(spark, x[20:], 20).repartition(3).write.parquet(str(tmp_path / "in"))

    def put(rows, batch):
        index.write(rows, batch + 1)
        index.write(rows, batch + 1)  # delivered again

    stream = spark.readStream.schema("uuid long, collection string, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.uuid for r in index.rows().collect()) == list(range(60)) and len(index.commits.batches()) > 2


def test_rebuilt_index_equals_one_from_scratch(spark, sf):
    rows = records(spark, sf).withColumn("collection", F.col("data_type")).withColumn("embedding", F.when(F.col("uuid") % 5 > 0, F.col("embedding")))
    embed = lambda some: some.select("uuid", F.array(*[F.lit(float(i)) + F.col("uuid") for i in range(64)]).cast("array<float>").alias("embedding"))
    a, b = (ivf.VectorIndex(spark, f"{scratch.checkpoints(spark)}/test-{uuid.uuid4().hex}", 64) for _ in "ab")
    a.build(rows.where("uuid % 3 = 0").select("uuid", "collection", "embedding"))
    for index, first in ((a, 1), (b, 0), (a, 1)):
        ivf.rebuild(index, rows, embed, first)
    same = [sorted((r.uuid, r.collection, r.v) for r in index.rows().collect()) for index in (a, b)]
    assert same[0] == same[1] and len(same[0]) == rows.where("status = 'active' and superseded_by is null").count()


def test_table_functions(spark, place):
    from tessella.api import register_search

    texts = {i: ("ab"[i % 2], t) for i, t in enumerate(["the cat sat", "The dog", "cat cat cat dog", None, "", "vital", "dog days of the cat"])}
    index = postings.Postings(spark, place, buckets=8)
    index.write(rows_of(spark, texts), 0)
    index.delete(spark.createDataFrame([(2,)], "uuid long"), 1)
    live = F.when(F.col("uuid") == 4, "deleted").otherwise("active")
    rows = rows_of(spark, texts).select("*", live.alias("status"), F.lit(None).cast("long").alias("superseded_by"), F.array(F.lit(1.0), F.col("uuid") / 2).cast("array<float>").alias("embedding"))
    register_search(spark, rows, index)
    for asked in ("Cat the THE dog", "vital", "nowhere", "?!"):
        words = re.findall(r"[^\W_]+", asked.lower())
        for who in "ab":
            got = {r.uuid: round(r.score, 6) for r in spark.sql("select * from search_words(:asked, :who)", {"asked": asked, "who": who}).collect()}
            assert got == {u: s for (p, u), s in told(index, words).items() if p == who}
    assert spark.sql("select * from search_words(null, 'a')").count() == 0 and spark.sql("select * from search_near(null, 'a')").count() == 0
    near = {r.uuid: r.sim for r in spark.sql("select * from search_near(array(1D, 0D), 'a')").collect()}
    assert near == {u: round(1 / math.hypot(1, u / 2), 6) for u in (0, 2, 6)}
    assert spark.sql("select * from search_near(array(1D), 'a')").count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = spark.sql("select * from search_words('dog', 'a')")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\n]*bucket[^\n]*PushedFilters", plan)


def test_postings_are_listed_in_bounded_chunks(spark, place, monkeypatch):
    """Fewer rows than postings are shuffled, sorted and kept; a chunk ends at its bound, within a batch as well."""
    import pyarrow as pa

    words = pa.array([["b", "a", "b"], None, [], ["c"] * 9, ["a", "c"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "x", None, "y", "x"]), pa.array([1, 2, 3, 4, 5]), words], ["profile", "uuid", "words"])
    want = {("x", "b", 1, 2, 3), ("x", "a", 1, 1, 3), ("y", "c", 4, 9, 9), ("x", "a", 5, 1, 2), ("x", "c", 5, 1, 2)}
    for chunk, most in ((1 << 22, 4), (4, 5), (1, 5)):
        monkeypatch.setattr(postings, "CHUNK", chunk)
        blocks = pa.Table.from_batches(list(postings._split(iter([batch, batch.slice(1, 2)])))).to_pylist()
        told_ = [(b["profile"], b["term"], h["uuid"], h["tf"], h["len"]) for b in blocks for h in b["held"]]
        assert len(blocks) == most and len(told_) == 5 and set(told_) == want
        assert all(t.num_rows <= 4 for t in postings._chunks(iter([batch]), lambda b: postings._lengths(b["words"]))) or chunk > 4
        each = pa.RecordBatch.from_pylist([dict(zip(("profile", "term", "uuid", "tf", "len"), r)) for r in told_])
        again = pa.Table.from_batches(list(postings._gathered(iter([each])))).to_pylist()
        assert sorted((b["profile"], b["term"], h["uuid"], h["tf"], h["len"]) for b in again for h in b["held"]) == sorted(want)
    monkeypatch.undo()
    index = postings.Postings(spark, place, buckets=4)
    index.write(rows_of(spark, {i: ("a", "the same words") for i in range(400)}), 0)
    stored = spark.read.parquet(f"{place}/postings")
    assert index.read("postings").count() > 1200 and stored.count() <= 100


def test_index_rebuilt_keeps_records_without_a_direction(spark, tmp_path):
    import zlib

    import duckdb

    import __spark_entry__ as entry

    spot = lambda w: (zlib.crc32(w.encode()) % 64, bool(zlib.crc32(w.encode()) & 0x10000))
    first = {spot(f"w{i}"): f"w{i}" for i in range(2000)}
    cancels = next(f"{w} {first[at, not sign]}" for (at, sign), w in first.items() if (at, not sign) in first)
    texts = ["", None, cancels, "!!! ---", "plain words", f"{cancels} {cancels}"]
    docs = [(i, texts[i % 6], "en", "web", len(texts[i % 6] or "")) for i in range(1, 61)]
    none, odd = [0.0] * 64, [1.0] * 63 + [float("nan")]
    vectors = [(i, 0, none if i % 7 == 1 else odd if i % 7 == 2 else [float((i * k) % 11 - 5) for k in range(1, 65)]) for i in range(1, 61) if i % 5]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    con.sql("create view benchmark as select 0 as item_id, 'a' as text")
    want = sorted(con.sql(entry.oracle_sql()["index_rebuilt"]).fetchall())
    for _ in range(2):  # built, and found built
        assert sorted(tuple(r) for r in entry.queries()["index_rebuilt"](spark, str(tmp_path)).select("uuid", "size", "renewed").collect()) == want
