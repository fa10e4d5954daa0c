"""The event history in batch form; streaming/history.py has the same steps as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


Step = Callable[[Any], tuple | None]


def current_state(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type): each key's last event."""
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    return events.groupBy("user_id").agg(last).select("user_id", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"))


def rolling_calls(events: DataFrame, budget: int, seconds: int = 3600) -> DataFrame:
    """(event_id, calls, over): calls of the same caller within the last seconds, itself included."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("calls", F.count("*").over(w)).select("event_id", "calls", (F.col("calls") > budget).alias("over"))


def _folded(events: DataFrame, schema: str, start: Callable[[], Step]) -> DataFrame:
    """Rows that a fold over each user's events in order (ts, event_id) gives; start() makes a user's step, from an event to a row or None.

    A task goes through sorted batches with one user's state at a time, so a long history is never held whole.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, step = None, None
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                if step is None or row.user_id != user:
                    user, step = row.user_id, start()
                made = step(row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    return events.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, schema)


def throttled(turns: DataFrame, every: int = 5, seconds: float = 30.0) -> DataFrame:
    """(key, event_id): events of a key that pass a throttle: every n-th one, if enough time has gone by since the last that passed."""

    def start() -> Step:
        n, last = 0, None

        def step(row):
            nonlocal n, last
            n += 1
            if n % every == 0 and (last is None or (row.ts - last).total_seconds() >= seconds):
                last = row.ts
                return row.user_id, row.event_id

        return step

    return _folded(turns.select("user_id", "event_id", "ts"), "user_id long, event_id long", start)


def breaker_step(bad: int, since: int | None, at: int, failed: bool, failures: int, open_micros: int) -> tuple[int, int | None]:
    """(failures in a row, microseconds since which it is open) after a call at a time; a failed call after the open time opens it anew, a good one closes it."""
    half = since is not None and at - since >= open_micros
    if failed:
        bad += 1
        return bad, at if half or bad >= failures else since
    return (0, None) if since is None or half else (bad, since)


def breaker_states(events: DataFrame, failures: int = 5, open_seconds: float = 120.0) -> DataFrame:
    """(user_id, event_id, state) after each event: closed, or open after that many failures in a row; the stream tells half_open as well."""

    def start() -> Step:
        bad, since = 0, None

        def step(row):
            nonlocal bad, since
            bad, since = breaker_step(bad, since, row.ts.value // 1000, row.event_type == "error", failures, round(open_seconds * 1e6))
            return row.user_id, row.event_id, "closed" if since is None else "open"

        return step

    return _folded(events.select("user_id", "event_id", "ts", "event_type"), "user_id long, event_id long, state string", start)


def session_tail(messages: DataFrame, last: int = 40, chars: int = 2000) -> DataFrame:
    """(conv_id, n, tail): the last messages of a session, each cut, in order."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, chars)).alias("line"))))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("tail"))
