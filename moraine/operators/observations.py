"""The observation table: idempotent append, staleness, lookback, seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import Commit, KeyedTable

KEY = ["lake_id", "captured_at", "source"]
#: Fixed values, in days.
LOOKBACK, STALE_AFTER = 548, 60

#: Fixed value: why a lake of the registry has no results.
NOT_SEEDED = "lake not seeded in DB"


def new_rows(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet; of a repeated key the least scene_id."""
    rest = [c for c in incoming.columns if c not in KEY]
    first = F.min(F.struct("scene_id", *[c for c in rest if c != "scene_id"]))
    fresh = incoming.groupBy(*KEY).agg(first.alias("_r")).select(*KEY, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return fresh.join(existing.select(*KEY), KEY, "left_anti").select(*incoming.columns)


def identified(rows: DataFrame, run_id: str) -> DataFrame:
    """With what the table adds to each row that is written: a row_id of its own and the run's id."""
    return rows.withColumns({"row_id": F.expr("uuid()"), "run_id": F.lit(run_id)})


def table(spark: SparkSession, path: str, scene_id: str = "long") -> KeyedTable:
    """The observation table at ``path``: one row a lake, day and source, whoever appends first.  Its columns
    are fixed, whatever the first rows had; ``scene_id`` is the type of the scenes' ids."""
    schema = f"lake_id long, captured_at date, source string, scene_id {scene_id}, area_km2 double, cloud_fraction double, row_id string, run_id string"
    return KeyedTable(spark, path, schema, KEY, order="scene_id", pruned="captured_at")


def append(incoming: DataFrame, path: str, run_id: str | None = None) -> Commit:
    """Append what is new to the table at ``path``; other writers may append at the same time."""
    rows = identified(incoming, run_id) if run_id else incoming
    return table(incoming.sparkSession, path, incoming.schema["scene_id"].dataType.simpleString()).append(rows)


def stale(last: Column, now: Column) -> Column:
    """No observation, or more than 60 days of exact time since the last (60 days sharp is fresh)."""
    return last.isNull() | (now - F.expr(f"INTERVAL {STALE_AFTER} DAYS") > last)


def status(lakes: DataFrame, observations: DataFrame, now: str) -> DataFrame:
    """lake_id, last_captured_at, stale for every lake, over all sources."""
    last = observations.groupBy("lake_id").agg(F.max("captured_at").alias("last_captured_at"))
    joined = lakes.select("lake_id").join(last, "lake_id", "left")
    return joined.withColumn("stale", stale(F.col("last_captured_at").cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")))


def lookback(observations: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """The last 548 days; later rows stay too unless ``strict`` (a past as_of sees them)."""
    day = F.lit(as_of).cast("date")
    found = observations.filter(F.col("captured_at") >= F.date_sub(day, LOOKBACK))
    return found.filter(F.col("captured_at") <= day) if strict else found


def seeded(registry: DataFrame, lakes: DataFrame) -> DataFrame:
    """``registry`` (slug, ordinal) with lake_id, or an error text for a lake that is not there."""
    joined = registry.join(lakes.select("slug", "lake_id"), "slug", "left")
    return joined.withColumn("error", F.when(F.col("lake_id").isNull(), F.lit(NOT_SEEDED)))
