"""Batches of additions from check to index: what goes in, what is found, and that a batch counts once."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import enrich
from tessella.operators.embed import hashing
from tessella.sources import scratch
from tessella.sources.intake import Intake
from tessella.sources.records import RECORD, now, records


@pytest.fixture
def place(spark):
    return f"{scratch.checkpoints(spark)}/test-{uuid.uuid4().hex}"


SCHEMA = "uuid long, profile string, content string, data_type string, topic string, keywords array<string>, embedding array<float>, more string"


def unit(*x):
    return [float(y) for y in np.array(x, float) / np.linalg.norm(x)]


def batch(spark, *rows):
    return spark.createDataFrame([(u, "alpha", text, kind, None, None, v, "x") for u, text, kind, v in rows], SCHEMA)


def told(intake, number):
    return {r.uuid: (r.verdict, r.match, r.contradicts) for r in intake.verdicts().where(F.col("batch") == number).collect()}


def test_a_batch_is_checked_stored_indexed_and_recorded(spark, place):
    intake = Intake(spark, place, "alpha", 3, buckets=4)
    assert intake.rows().count() == 0 and intake.near([1, 0, 0]).count() == 0
    first = batch(spark, (1, "the cat sat", "CODE", unit(1, 0, 0)), (2, "a dog", "CODE", unit(0, 1, 0)), (3, "the cat sat", "CODE", unit(1, 0, 0)), (4, "", "CODE", None), (5, "no vector here", "CODE", None), (5, "zz", "CODE", None), (None, "no id", "CODE", None))
    foreign = first.where("uuid = 2").withColumns({"profile": F.lit("beta"), "uuid": F.lit(9)})
    assert intake.add(first.union(foreign), 0, now()) and not intake.add(first, 0, now())
    assert told(intake, 0) == {1: ("added", None, None), 2: ("added", None, None), 3: ("repeated", 1, None), 4: ("rejected", None, None), 5: ("added", None, None)}
    assert {r.uuid: r.content for r in intake.rows().collect()} == {1: "the cat sat", 2: "a dog", 5: "no vector here"}
    # a near copy, an uuid that is there, one like the dog's that was written two months later, and something new
    second = batch(spark, (10, "the cat sat down", "CODE", unit(1, 0.01, 0)), (2, "other text", "CODE", unit(0, 0, 1)), (11, "a dog, but another", "CODE", unit(0, 1, 0.5)), (12, "a bird", "CODE", unit(0, 0, 1)))
    later = F.lit("2026-03-05 00:00:00").cast("timestamp_ntz")
    assert intake.add(second, 1, later)
    assert told(intake, 1) == {10: ("duplicate", 1, None), 2: ("known", None, None), 11: ("supersedes", 2, 2), 12: ("added", 1, None)}
    rows = {r.uuid: r for r in intake.rows().collect()}
    assert set(rows) == {1, 2, 5, 11, 12} and rows[2].superseded_by == 11 and rows[2].content == "a dog" and str(rows[2].updated_at).startswith("2026-03-05")
    # hidden records aren't found, neither by words nor by vectors
    assert [r.uuid for r in intake.find(["dog"]).collect()] == [11] and [r.uuid for r in intake.find(["cat", "bird"]).collect()] != []
    assert [r.uuid for r in intake.near([0, 1, 0.1], 5).collect()] == [11, 12, 1]
    log = {(r.uuid, r.action, tuple(r.changed), r.batch) for r in intake.history().collect()}
    assert log == {(1, "added", (), 0), (2, "added", (), 0), (5, "added", (), 0), (11, "added", (), 1), (12, "added", (), 1), (2, "updated", ("superseded_by",), 1)}
    before = sorted(map(str, intake.rows().collect())), sorted(map(str, intake.find(["the", "dog", "bird"]).collect())), sorted(map(str, intake.near([0.3, 1, 0.2], 4).collect()))
    assert intake.compact(2) and not intake.compact(2)
    assert before == (sorted(map(str, intake.rows().collect())), sorted(map(str, intake.find(["the", "dog", "bird"]).collect())), sorted(map(str, intake.near([0.3, 1, 0.2], 4).collect())))
    assert [(r.batch, r.n, r.added, r.supersedes, r.known) for r in intake.ledger().orderBy("batch").collect()] == [(0, 5, 3, 0, 0), (1, 4, 1, 1, 1)]
    assert intake.history().count() == 6 and len(told(intake, 0)) == 5
    with pytest.raises(ValueError):
        intake.add(first, 1 - 2, now())


def test_a_broken_batch_goes_on_with_the_answers_it_had(spark, place, monkeypatch):
    rows = batch(spark, (1, "the cat sat", None, None), (2, "a dog", None, None))
    answers = lambda tag: lambda prompts: [f"Sure: {json.dumps({'summary': tag, 'topic': tag, 'keywords': ['Cat', tag, '']})} bye" if "cat" in p else "no json" for p in prompts]
    broken = Intake(spark, place, "alpha", 8, [hashing(8)], answers("one"), buckets=2)
    monkeypatch.setattr(broken.words, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        broken.add(rows, 0, now())
    again = Intake(spark, place, "alpha", 8, [hashing(8)], answers("two"), buckets=2)
    assert again.rows().count() == 0 and again.history().count() == 0
    assert again.add(rows, 0, now()) and not again.add(rows, 0, now())
    got = {r.uuid: (r.summary, r.topic, r.keywords, len(r.embedding)) for r in again.rows().collect()}
    assert got == {1: ("one", "one", ["Cat", "one"], 8), 2: ("a dog", None, [], 8)}
    assert [r.uuid for r in again.find(["cat"]).collect()] == [1] and again.near(again.rows().where("uuid = 2").first().embedding, 1).first().uuid == 2


def test_enriched_leaves_what_is_there(spark):
    full = spark.createDataFrame([(1, "s", "t", ["a", "b", "c", "d", "e"], "text", "agent"), (2, None, "t", ["A"], None, "agent"), (3, None, None, ["a"], "x" * 300, "agent")], "uuid long, summary string, topic string, keywords array<string>, content string, source string")
    asked = []

    def model(prompts):
        asked.extend(prompts)
        return ['{"summary": 5, "topic": [], "keywords": ["a", "z"]}' for _ in prompts]

    got = {r.uuid: (r.summary, r.topic, r.keywords) for r in enrich.enriched(full, model).collect()}
    assert got[1] == ("s", "t", ["a", "b", "c", "d", "e"]) and got[2][1:] == ("t", ["A", "z"]) and got[3][2] == ["a", "z"]
    plain = {r.uuid: (r.summary, r.topic, r.keywords) for r in enrich.enriched(full).collect()}
    assert plain[3] == ("x" * 100, None, ["a"]) and plain[2] == (None, "t", ["A"])
    empty = full.limit(0)
    assert enrich.enriched(empty, model).count() == 0


def test_the_store_of_the_tables_taken_in_by_batches(spark, sf, place):
    """Two batches give the records, the words and the vectors that one gives."""
    rows = records(spark, sf).where("profile = 'alpha' and status = 'active'").withColumn("superseded_by", F.lit(None).cast("long"))
    parts = [rows.where("uuid % 2 = 0"), rows.where("uuid % 2 = 1")]
    intake = Intake(spark, place, "alpha", 64, buckets=4)
    for i, part in enumerate(parts):
        assert intake.add(part, i, now(), 2.0, 1.5, 1.4)
    said = intake.verdicts().groupBy("verdict").count().collect()
    kept = intake.rows()
    assert kept.count() == sum(r["count"] for r in said if r.verdict in ("added", "supersedes")) and kept.select("content").distinct().count() == kept.count()
    q = rows.where("embedding is not null").orderBy("uuid").first().embedding
    from tessella.operators import retrieval

    want = retrieval.vector_scores(kept, spark.createDataFrame([(q,)], "q array<float>")).orderBy(F.desc("sim"), "uuid").limit(5).collect()
    assert [r.uuid for r in intake.near(q, 5).collect()] == [r.uuid for r in want]
    assert [c.name for c in kept.schema] == [c.split()[0] for c in RECORD.split(", ")]


def test_a_log_takes_a_batch_once(spark, place):
    from datetime import datetime

    from tessella.sources.logs import Log

    log = Log(spark, place, "ts timestamp_ntz, query string")
    day = lambda n, *texts: spark.createDataFrame([(datetime(2026, 1, n, i), t, 1) for i, t in enumerate(texts)] + [(None, "no time", 1)], "ts timestamp_ntz, query string, other int")
    assert log.read().count() == 0 and log.recent("query").count() == 0
    assert log.write(day(1, "Old cat"), 0) and log.write(day(9, "a Cat", "dog", None), 1) and not log.write(day(9, "again"), 1) and log.write(day(10, "cats"), 2)
    assert log.read().count() == 8
    assert [r.query for r in log.recent("query", "cat").collect()] == ["cats", "a Cat"] and log.recent("query", limit=0).count() == 1
    assert log.prune("2026-01-09") == ["batch=0/day=2026-01-01"] and log.read().count() == 7 and not log.write(day(1, "Old cat"), 0)


def test_what_a_retrieve_leaves_behind(spark, sf):
    from datetime import datetime

    from tessella.api import Store

    rows = records(spark, sf).cache()
    store = Store(rows, "alpha", datetime(2026, 1, 1))
    words = store.own.where("status = 'active'").orderBy("uuid").first().content[:60]
    found = store.retrieve(words, limit=3)
    told, new = store.left_behind(words, found)
    ids = {r.uuid for r in found.collect()}
    line = told.first()
    assert set(line.uuids) == ids and line.n == len(ids) and line.query == words and line.low_relevance is False
    grown = new.select("uuid", F.col("reference_count").alias("n")).join(rows.select("uuid", "reference_count"), "uuid").where("n > reference_count")
    assert {(r.uuid, r.n - r.reference_count) for r in grown.collect()} == {(i, 1) for i in ids} and new.count() == rows.count()
    none = store.left_behind("nothing", found.limit(0))[0].first()
    assert none.n == 0 and none.uuids == [] and none.low_relevance
