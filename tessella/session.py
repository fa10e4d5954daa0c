"""Spark session with the settings that every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessella", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution. Keyword arguments set further options, dots as double underscores."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
