"""Streams with state that expires, against their batch twins."""

import time

from pyspark.sql import functions as F

from tessella.operators import history
from tessella.streaming import history as stream

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def in_order(events, path, parts=3):
    """Files that a stream takes one after the other, in order of time."""
    edges = [r.ts for r in events.select("ts").orderBy("ts").collect()]
    for i in range(parts):
        lo, hi = edges[i * len(edges) // parts], edges[(i + 1) * len(edges) // parts] if i + 1 < parts else None
        some = events.where(F.col("ts") >= lo) if hi is None else events.where((F.col("ts") >= lo) & (F.col("ts") < hi))
        some.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def test_breaker_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    in_order(events, str(tmp_path / "in"))
    stream.drain(stream.breaker(stream.read_events(spark, str(tmp_path / "in"), 1), 2, 3600), str(tmp_path / "out"), str(tmp_path / "cp"), timers=True)
    got = spark.read.parquet(str(tmp_path / "out"))
    rows = lambda df: sorted((r.user_id, r.event_id, r.state) for r in df.collect())
    assert rows(got) == rows(history.breaker_states(events.withColumn("ts", F.col("ts").cast("timestamp")), 2, 3600)) and got.where("state = 'open'").count() > 0


def one(spark, path, i, kind, user=1):
    spark.sql(f"select {i}L as event_id, timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, {i}) as ts, {user}L as user_id, '{kind}' as event_type, 0D as value, '' as props").coalesce(1).write.mode("append").parquet(path)


def test_timers_tell_half_open_and_idle_state_expires(spark, tmp_path):
    src = str(tmp_path / "in")

    def run(idle):
        stream.drain(stream.breaker(stream.read_events(spark, src, 1), 2, 1.0, idle), str(tmp_path / "out"), str(tmp_path / "cp"), timers=True)
        return [(r.event_id, r.state) for r in spark.read.parquet(str(tmp_path / "out")).orderBy(F.col("event_id").asc_nulls_last()).collect()]

    one(spark, src, 1, "error")
    one(spark, src, 2, "error")
    assert run(4000) == [(1, "closed"), (2, "open")]
    time.sleep(1.5)
    one(spark, src, 3, "click", user=2)
    assert run(4000) == [(1, "closed"), (2, "open"), (3, "closed"), (None, "half_open")]
    time.sleep(5)
    # the failures of user 1 are forgotten by now
    one(spark, src, 4, "error")
    assert (4, "closed") in run(4000)


def test_ledger_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    in_order(events, str(tmp_path / "in"))
    stream.drain(stream.ledger(stream.read_events(spark, str(tmp_path / "in"), 1), 5), str(tmp_path / "out"), str(tmp_path / "cp"), timers=True)
    told: dict = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        told.setdefault(r.user_id, {}).setdefault(r.as_of, {})[r.hook] = (r.runs, r.stored)
    mine: dict = {}
    for r in events.select("user_id", "ts", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).collect():
        mine.setdefault(r.user_id, []).append(r)
    for user, rows in mine.items():
        want: dict = {}
        newest = sorted(rows, key=lambda r: (r.ts, r.event_id))[-5:]
        for r in newest:
            n, s = want.get(r.event_type, (0, 0))
            want[r.event_type] = (n + 1, s + (r.k or 0))
        assert told[user][newest[-1].event_id] == want
