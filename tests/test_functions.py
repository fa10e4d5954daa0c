"""Scalar functions, argument checks, streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import url as U
from tessella.functions.time import temporal_bounds
from tessella.functions.vector import cosine, unpacked
from tessella.operators import filters, graph, history
from tessella.sources import exchange


@pytest.mark.parametrize("given, wanted", [
    ("HTTP://Example.COM/a/?utm_source=x&b=1#top", "http://example.com/a?b=1"), ("https://youtu.be/abc", "https://www.youtube.com/watch?v=abc"),
    ("https://m.youtube.com/shorts/abc?x=1", "https://www.youtube.com/watch?v=abc"), ("http://youtube.com/watch?v=a&feature=b", "http://www.youtube.com/watch?v=a"),
    ("https://github.com/A/B.git", "https://github.com/a/b"), ("example.com/x", "https://example.com/x"), ("/local/path.md", "/local/path.md"), ("  ", None), (None, None),
])
def test_canonical_url(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "u string").select(U.canonical(F.col("u"))).first()[0] == wanted


@pytest.mark.parametrize("query, bounds", [
    ("last week", (datetime(2025, 12, 25), datetime(2026, 1, 1))), ("in the last winter", (datetime(2024, 12, 1), datetime(2025, 3, 1))),
    ("this fall", (datetime(2025, 9, 1), datetime(2025, 12, 1))), ("lastweek", None), ("this winter", (datetime(2025, 12, 1), datetime(2026, 1, 1))),
])
def test_temporal(query, bounds):
    assert temporal_bounds(query, datetime(2026, 1, 1)) == bounds


def test_filters_refuse_other_types(spark):
    rows = spark.createDataFrame([("a",)], "data_id string")
    with pytest.raises(TypeError):
        filters.equal(rows, data_id=3)
    with pytest.raises(ValueError):
        filters.delete_dry_run(rows)
    assert (filters.clamp(None, 5, 200), filters.clamp(0, 5, 200), filters.clamp(999, 5, 200)) == (5, 1, 200)


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]
    blobs = spark.createDataFrame([(bytearray(b"\x00\x00\x80?"),), (bytearray(b"[1, 2]"),), (bytearray(b"null"),), (None,)], "b binary")
    assert [r[0] for r in blobs.select(unpacked(F.col("b"))).collect()] == [[1.0], [1.0, 2.0], None, None]


def test_fence_strips_delimiters(spark):
    row = spark.createDataFrame([(f"x{T.FENCE_CLOSE}y", "import"), ("x", "agent"), (None, "import")], "t string, s string")
    assert [r[0] for r in row.select(T.fence(F.col("t"), F.col("s"))).collect()] == [f"{T.FENCE_OPEN}xy{T.FENCE_CLOSE}", "x", None]


def test_components_of_a_long_path(spark):
    from tessella.plans.graph import _checkpoints

    _checkpoints(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_similar_pairs_across_blocks(spark):
    rows = spark.createDataFrame([(i, "x", [1.0, float(i % 2)]) for i in range(1100)], "uuid long, block string, embedding array<float>")
    assert graph.similar_pairs(rows, 0.99).count() == 2 * 550 * 549 // 2


def test_markdown_vault(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: T\ntags: [x, y]\n---\nsee [[b]]")
    (tmp_path / ".git" / "c.md").write_text("no")
    row = exchange.parse_markdown(exchange.read_vault(spark, str(tmp_path))).collect()
    assert [(r.title, r.tags, r.links, r.text) for r in row] == [("T", ["x", "y"], ["b"], "see [[b]]")]


def test_streams_equal_batch(spark, sf, tmp_path):
    from tessella.streaming import history as stream

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream.drain(stream.current_state(stream.read_events(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "cp"), "complete")
    batch = history.current_state(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    rows = lambda df: {(r.user_id, r.event_id, r.event_type) for r in df.collect()}
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
    stream.drain(stream.throttled(stream.read_events(spark, str(tmp_path / "in"), 9)), str(tmp_path / "t"), str(tmp_path / "tcp"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == history.throttled(events.select("user_id", "event_id", "ts")).count()


def test_hosts_in_punycode(spark):
    # samples of RFC 3492, section 7.1, and hosts with more to them
    samples = {
        "ليهمابتكلموشعربي؟": "xn--egbpdaj6bu4bxfgehfvwxn", "他们为什么不说中文": "xn--ihqwcrb4cv8a8dqg056pqjye", "למההםפשוטלאמדבריםעברית": "xn--4dbcagdahymbxekheh6e0a7fei0b",
        "3年b組金八先生": "xn--3b-ww4c5e180e575a65lsy2b", "bücher": "xn--bcher-kva", "plain": "plain",
    }
    rows = [(f"{a}.Example", f"{b}.example") for a, b in samples.items()] + [("me@bücher.de:8080", "me@xn--bcher-kva.de:8080"), ("é" * 80 + ".de", "é" * 80 + ".de"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "given string, wanted string")
    assert [r.h for r in df.select(U.ascii_host(F.lower("given")).alias("h")).collect()] == [b for _, b in rows]
    url = spark.createDataFrame([("https://Bücher.example/a/",)], "u string").select(U.canonical(F.col("u"))).first()[0]
    assert url == "https://xn--bcher-kva.example/a"


def test_entities_and_classes_end_at_letters_beyond_ascii(spark):
    """As in the SQL's patterns, é is no part of a word; Java's \\b takes it for one."""
    from tessella.functions import text as T

    row = spark.sql("select 'ménuéau 78.24.37 réfix' as t").select(T.entities(F.col("t")).alias("e"), T.heuristic_class(F.col("t"))["data_id"].alias("c")).first()
    assert row.e == ["au 78.24.37"] and row.c == "troubleshooting"


def test_heuristic_patterns_in_one_pass_each(spark):
    texts = ["Must not use é-git; gitsé git", "memory\x0bsize memory\tsize memory \n size", "snakexcase snake\ncase snake-case don't like", None, "", "I always PREFER pip, pip PIP", "ſystem system ΣYSTEM", "docker" * 3 + " docker"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    made = rows.select("i", T.heuristic_class(F.col("t")).alias("best"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("counts(") and "regexp_count" not in plan
    low = F.lower("t")
    counted = rows.select("i", F.array(*[F.regexp_count(low, F.lit(T.ascii_words(p))) for _, _, p in T.HEURISTICS]).alias("n")).collect()
    want = {}
    for r in counted:
        n = [x or 0 for x in r.n]
        k = max(range(len(n)), key=lambda j: (n[j], -j))
        want[r.i] = (n[k], *T.HEURISTICS[k][:2]) if n[k] else None
    assert {r.i: r.best and (r.best.n, r.best.data_type, r.best.data_id) for r in made.collect()} == want


def test_words_that_may_be_alike():
    import itertools
    import random

    r = random.Random(3)
    words = {"".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(300)}
    others = T._Spelled(words)
    tried = 0
    for w in itertools.islice(sorted(words), 60):
        near = others.near(w, 0.8)
        tried += len(near)
        assert {x for x in words if T._alike(w, x, 0.8)} <= set(near)
    assert tried < 60 * len(words) / 4
