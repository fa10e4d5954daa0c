"""Time functions; the clock is always an argument."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: recency falls to 1 / (1 + days * RECENCY) with RECENCY = 1 / (21 ln 2).
RECENCY = 1.0 / (21.0 * 0.6931471805599453)


def age_seconds(at: Column, now: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(now) - micros(at)) / 1e6


def age_days(at: Column, now: Column) -> Column:
    """Whole days, at least 0."""
    return F.greatest(F.floor(age_seconds(at, now) / 86400.0), F.lit(0))


def recency(at: Column, now: Column, pinned: Column) -> Column:
    return F.when(pinned, 1.0).when(at.isNull(), 0.5).otherwise(1.0 / (1.0 + age_days(at, now) * RECENCY))


def ttl(text: Column, now: Column) -> Column:
    """An instant from 'N h', 'N d', 'N w', 'N m' (30 days) or an ISO time; null if it is neither."""
    n = F.try_to_number(F.regexp_extract(text, r"^\s*([0-9]{1,6})\s*([hdwm])\s*$", 1), F.lit("999999")).cast("int")
    unit = F.regexp_extract(text, r"^\s*([0-9]{1,6})\s*([hdwm])\s*$", 2)
    hours = n * F.when(unit == "h", 1).when(unit == "d", 24).when(unit == "w", 168).otherwise(720)
    return F.when(unit != "", now + F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0))).otherwise(text.try_cast("timestamp_ntz"))


def temporal_bounds(query: str, now: datetime) -> tuple[datetime, datetime] | None:
    """(from, to) of the first temporal phrase, in this order of phrases; None without one."""
    month = now.replace(day=1)
    week = timedelta(days=now.weekday())
    before = lambda end: now.year - 1 if now.month < end else now.year
    whole = lambda y, a, b: (datetime(y, a, 1), b)
    winter = now.year if now.month >= 3 else now.year - 1
    phrases: list[tuple[str, datetime, datetime]] = [
        ("last week", now - timedelta(days=7), now), ("this week", now - week, now + timedelta(days=6) - week),
        ("last month", (month - timedelta(days=1)).replace(day=1), month), ("this month", month, now),
        ("recent", now - timedelta(days=30), now), ("last year", now - timedelta(days=365), now), ("this year", now.replace(month=1, day=1), now),
        ("last spring", *whole(before(6), 3, datetime(before(6), 5, 31, 23, 59, 59))), ("last summer", *whole(before(9), 6, datetime(before(9), 8, 31, 23, 59, 59))),
        ("last fall", *whole(before(12), 9, datetime(before(12), 11, 30, 23, 59, 59))), ("last winter", datetime(winter - 1, 12, 1), datetime(winter, 3, 1)),
    ]
    for name, first, last in (("spring", 3, 6), ("summer", 6, 9), ("fall", 9, 12), ("winter", 12, 3)):
        year = now.year if datetime(now.year, first, 1) <= now else now.year - 1
        end = datetime(year + (last < first), last, 1)
        phrases.append((f"this {name}", datetime(year, first, 1), min(end, now)))
    for phrase, a, b in phrases:
        if re.search(r"\b" + phrase.replace(" ", r"\s+") + r"\b", query.lower()):
            return a, b
    return None
