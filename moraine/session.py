"""A session with what the engine relies on: UTC, ANSI, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName("moraine")
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in (defaults | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
