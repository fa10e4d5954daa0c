"""Structured Streaming over the event history: current state, ledger counts, throttle.

Each stream equals its batch twin in operators/history.py once the input is drained
(``Trigger.AvailableNow``); state is kept by key, late events are bounded by a watermark
where an aggregate is windowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import breaker_step

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def current_state(events: DataFrame) -> DataFrame:
    """Each key's last event, as a running aggregate (output mode complete or update)."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    return events.groupBy("user_id").agg(last).select("user_id", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"))


def ledger_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs by hook and window; windows close when the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), F.col("event_type").alias("hook")).agg(F.count("*").alias("runs"), F.sum("value").alias("value"))


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events once each, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def throttled(events: DataFrame, every: int = 5, seconds: float = 30.0) -> DataFrame:
    """Every n-th event of a key, if enough time has gone by since the last one that passed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1.0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for row in rows.itertuples():
            n += 1
            at = row.ts.timestamp()
            if n % every == 0 and (last < 0 or at - last >= seconds):
                last = at
                out.append((key[0], row.event_id))
        state.update((n, last))
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "n long, last double", "append", GroupStateTimeout.NoTimeout)


#: Milliseconds after which the state of a key that is no longer heard of expires.
IDLE = 24 * 3600 * 1000


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts", "event_id"])


def breaker(events: DataFrame, failures: int = 5, open_seconds: float = 120.0, idle: int = IDLE) -> DataFrame:
    """(user_id, event_id, state): breaker_states() of a stream, in micro-batches that come in order.

    While a breaker is open a timer of processing time waits for the end of the open time, and then tells half_open (with no
    event); the state of a key that is idle for longer is dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        bad, since, told, heard = state.get if state.exists else (0, None, False, now)
        if state.hasTimedOut:
            if since is None or told:
                state.remove()
                return
            state.update((bad, since, True, heard))
            state.setTimeoutDuration(idle)
            yield pd.DataFrame({"user_id": [key[0]], "event_id": pd.array([None], "Int64"), "state": ["half_open"]})
            return
        if now - heard > idle:  # a key that is heard of again doesn't time out
            bad, since = 0, None
        out = []
        for r in _in_order(batches).itertuples():
            bad, since = breaker_step(bad, since, r.ts.value // 1000, r.event_type == "error", failures, round(open_seconds * 1e6))
            out.append((key[0], r.event_id, "closed" if since is None else "open"))
        state.update((bad, since, False, now))
        state.setTimeoutDuration(idle if since is None else min(idle, max(1, round(open_seconds * 1000))))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "state"])

    rows = events.select("user_id", "event_id", "ts", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, state string", "bad int, since long, told boolean, heard long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ledger(events: DataFrame, runs: int = 200, idle: int = IDLE) -> DataFrame:
    """(user_id, hook, runs, stored, as_of): each owner's newest runs by hook after each micro-batch; as_of is the last run's id.

    A run that is delivered twice counts once while it is among the newest; an idle owner's state is dropped.
    """
    rows = events.select("user_id", "event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("stored"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        new = [(r.ts.value // 1000, r.event_id, r.event_type, 0 if pd.isna(r.stored) else int(r.stored)) for r in _in_order(batches).itertuples()]
        kept = sorted({*held, *new}, key=lambda x: x[:2], reverse=True)[:runs]
        state.update(tuple(map(list, zip(*kept))))
        state.setTimeoutDuration(idle)
        out = pd.DataFrame(kept, columns=["at", "event_id", "hook", "stored"]).groupby("hook", as_index=False).agg(runs=("event_id", "size"), stored=("stored", "sum"))
        yield out.assign(user_id=key[0], as_of=kept[0][1])[["user_id", "hook", "runs", "stored", "as_of"]]

    schema = "user_id long, hook string, runs long, stored long, as_of long"
    return rows.groupBy("user_id").applyInPandasWithState(step, schema, "at array<long>, ids array<long>, hooks array<string>, stored array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", timers: bool = False) -> None:
    """Runs a stream over all there is and stops; complete and update results replace the table at path each batch.

    A stream with timers of processing time would go on for their sake; with ``timers`` they are looked at only with the batches.
    """
    conf = stream.sparkSession.conf
    before = conf.get(NO_DATA)
    conf.set(NO_DATA, "false" if timers else before)
    try:
        out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if mode == "append":
            query = out.format("parquet").start(path)
        else:
            query = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
        query.awaitTermination()
    finally:
        conf.set(NO_DATA, before)
