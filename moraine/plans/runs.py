"""Runs over all lakes at once: latest, backfill, hazard; one result row a lake.

A lake that is not seeded gets an error row and stops nobody else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hazard, observations, scenes
from ..sources.keyed import Commit, KeyedTable, Rollup


def run_id(kind: str) -> str:
    return f"{kind}-{uuid.uuid4()}"


def _results(known: DataFrame, checked: DataFrame, new: DataFrame, existing: DataFrame, now: str | None) -> DataFrame:
    """One row a lake of the registry: what was written and checked, whether it is stale after that.  ``checked``
    may have an error of its own; a lake with an error is stale."""
    written = new.groupBy("lake_id").agg(F.count(F.lit(1)).alias("observations_written"))
    if "error" in checked.columns:
        checked = checked.withColumnRenamed("error", "_fault")
        known = known.withColumnRenamed("error", "_seed")
    found = known.join(checked, "lake_id", "left").join(written, "lake_id", "left")
    if "_fault" in checked.columns:
        found = found.withColumn("error", F.coalesce("_seed", "_fault"))
    columns = ["ordinal", "slug", F.coalesce("observations_written", F.lit(0)).alias("observations_written"), F.coalesce("scenes_checked", F.lit(0)).alias("scenes_checked"), "error"]
    if now is not None:
        seen = existing.select("lake_id", "captured_at").unionByName(new.select("lake_id", "captured_at"))
        status = observations.status(found.filter("error is null"), seen, now).select("lake_id", "stale")
        found = found.join(status, "lake_id", "left")
        columns.append(F.coalesce("stale", F.lit(True)).alias("stale"))
    return found.select(*columns)


def _spoiled(checked: DataFrame, all_scenes: DataFrame) -> DataFrame:
    """``checked`` (lake_id, scenes_checked, error) with the error of lakes whose search failed: nothing was
    checked of them."""
    if "fault" not in all_scenes.columns:
        return checked.withColumn("error", F.lit(None).cast("string")) if "error" not in checked.columns else checked
    lost = scenes.lost(all_scenes).withColumnRenamed("error", "_lost")
    both = checked.join(lost, "lake_id", "full_outer")
    return both.select("lake_id", F.when(F.col("_lost").isNull(), F.col("scenes_checked")).otherwise(F.lit(0)).alias("scenes_checked"), F.coalesce("_lost", "error").alias("error"))


def _newest(known: DataFrame, found: DataFrame, all_scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, checked) of ``found``, the newest usable scene of each lake."""
    checked = _spoiled(found.select("lake_id", "scenes_checked", *[c for c in ["error"] if c in found.columns]), all_scenes)
    chosen = known.select("lake_id").join(found.drop("error"), "lake_id").filter("scene_id is not null")
    if "fault" in all_scenes.columns:
        chosen = chosen.join(scenes.lost(all_scenes).select("lake_id"), "lake_id", "left_anti")
    measured = [c for c in ("area_km2", "cloud_fraction") if c in found.columns]
    return chosen.select("lake_id", F.to_date("acquired_at").alias("captured_at"), "source", "scene_id", *measured), checked


def run_latest(registry: DataFrame, lakes: DataFrame, all_scenes: DataFrame, existing: DataFrame, now: str | None = None, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, results): the newest usable scene of each lake.  With ``now``, results say which
    lakes are stale then; one with an error is.  Rows carry what the scene's pixels gave and ``run``."""
    known = observations.seeded(registry, lakes)
    rows, checked = _newest(known, scenes.latest_usable(all_scenes), all_scenes)
    new = observations.new_rows(rows, existing)
    return observations.identified(new, run or run_id("latest")), _results(known, checked, new, existing, now)


def _ranged(known: DataFrame, all_scenes: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(observations, checked) of a range of days: all usable scenes of a lake, newest first, up to the first
    that can't be read."""
    ranged = scenes.in_range(all_scenes, start, end).join(known.select("lake_id"), "lake_id", "left_semi")
    checked = scenes.before_fault(ranged)
    fault = F.max("fault") if "fault" in all_scenes.columns else F.lit(None).cast("string")
    counts = _spoiled(checked.groupBy("lake_id").agg(F.count(F.lit(1)).alias("scenes_checked"), fault.alias("error")), all_scenes)
    rows = scenes.first_of_day(checked)
    if "fault" in all_scenes.columns:
        rows = rows.join(scenes.lost(all_scenes).select("lake_id"), "lake_id", "left_anti")
    return rows, counts


def run_backfill(registry: DataFrame, lakes: DataFrame, all_scenes: DataFrame, existing: DataFrame, start: str, end: str, now: str | None = None, run: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, results): every usable scene of a range of days, with what its pixels gave."""
    known = observations.seeded(registry, lakes)
    rows, checked = _ranged(known, all_scenes, start, end)
    new = observations.new_rows(rows, existing)
    return observations.identified(new, run or run_id(f"backfill-{start}")), _results(known, checked, new, existing, now)


def _write(known: DataFrame, rows: DataFrame, checked: DataFrame, table: KeyedTable, run: str, now: str | None) -> tuple[Commit, DataFrame]:
    """Append ``rows``; the commit, and results counted from what it wrote."""
    commit = table.append(observations.identified(rows, run))
    return commit, _results(known, checked, commit.written, table.read(), now)


def backfill(registry: DataFrame, lakes: DataFrame, all_scenes: DataFrame, table: KeyedTable, start: str, end: str, now: str | None = None) -> tuple[Commit, DataFrame]:
    """:func:`run_backfill` written to the observation ``table``: the commit and the results."""
    known = observations.seeded(registry, lakes)
    return _write(known, *_ranged(known, all_scenes, start, end), table, run_id(f"backfill-{start}"), now)


def run_one(registry: DataFrame, all_scenes: DataFrame, slug: str) -> DataFrame:
    """One row for the lake ``slug`` without writing anything: its newest usable scene and exit_code, 0 if
    there is one, 1 if it has no scene or only cloudy ones (STALE), 2 if the registry (slug, lake_id)
    does not have it."""
    asked = registry.sparkSession.range(1).select(F.lit(slug).alias("slug"))
    mine = asked.join(registry.select("slug", "lake_id"), "slug", "left")
    # the filter on one lake reaches the scan of the scenes
    wanted = all_scenes.join(F.broadcast(registry.filter(F.col("slug") == slug).select("lake_id").limit(1)), "lake_id", "left_semi")
    found = mine.join(scenes.latest_usable(wanted), "lake_id", "left")
    code = F.when(F.col("lake_id").isNull(), 2).when(F.col("scene_id").isNull(), 1).otherwise(0)
    message = F.when(code == 2, F.lit("unknown lake")).when(code == 1, F.when(F.col("scenes_checked").isNull(), F.lit("no scenes")).otherwise(F.lit("STALE: no usable scene")))
    return found.select("slug", "lake_id", "scene_id", F.to_date("acquired_at").alias("captured_at"), F.coalesce("scenes_checked", F.lit(0)).alias("scenes_checked"), code.alias("exit_code"), message.alias("message"))


def summary(results: DataFrame) -> DataFrame:
    """Totals; ``failed`` is what makes a run's exit code 1."""
    return results.agg(
        F.coalesce(F.sum("observations_written"), F.lit(0)).cast("long").alias("observations_written"),
        F.coalesce(F.sum("scenes_checked"), F.lit(0)).cast("long").alias("scenes_checked"),
        F.count(F.lit(1)).alias("lakes"),
        F.coalesce(F.bool_or(F.col("error").isNotNull()), F.lit(False)).alias("failed"),
    )


def run_hazard(registry: DataFrame, lakes: DataFrame, static: DataFrame, obs: DataFrame, slope: DataFrame, as_of: str, exposure: DataFrame | None = None, computed_at: str | None = None, months: bool = False) -> DataFrame:
    """Score, tier and document of every lake of the registry, or why it has none; write it as the score
    table or send it on from there.

    Errors: the lake is not seeded, its static row is missing, no slope is known.  computed_at (a
    timestamp, by default now) is set for scored lakes; alert_created is for the receiver to fill.
    With ``months``, ``obs`` are the observations by lake and month.
    """
    known = hazard.with_static(observations.seeded(registry, lakes), static)
    done = hazard.components(hazard.risks(hazard.inputs(known, obs, slope, as_of, exposure=exposure, months=months)), as_of)
    at = F.lit(computed_at).cast("timestamp") if computed_at else F.current_timestamp()
    return done.select("ordinal", "slug", "lake_id", "score", "tier", "components", F.lit(None).cast("boolean").alias("alert_created"), F.when(F.col("score").isNotNull(), at).alias("computed_at"), "error")


def score_reports(scored: DataFrame, run: str) -> DataFrame:
    """What is reported of each scored lake of :func:`run_hazard`, one row a report: lakeId, runId, score,
    tier, components, computedAt (ISO 8601, UTC).  Lakes with an error are not reported."""
    utc = F.to_utc_timestamp("computed_at", F.current_timezone())
    at = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return scored.filter("score is not null").select(F.col("lake_id").cast("string").alias("lakeId"), F.lit(run).alias("runId"), "score", "tier", "components", at.alias("computedAt"))


def report_lines(found: DataFrame) -> DataFrame:
    """The outcome of :func:`run_one` as a line of text for people."""
    clear = F.format_string("lake: %s, scene: %s, captured: %s, scenes checked: %d", F.col("slug"), F.col("scene_id").cast("string"), F.col("captured_at").cast("string"), F.col("scenes_checked"))
    return found.select("slug", "exit_code", F.coalesce(F.when(F.col("exit_code") == 0, clear), F.concat_ws(": ", "slug", "message")).alias("line"))


def run_daily(registry: DataFrame, lakes: DataFrame, static: DataFrame, all_scenes: DataFrame, table: KeyedTable, slope: DataFrame, as_of: str, now: str, exposure: DataFrame | None = None, months: Rollup | None = None) -> tuple[DataFrame, DataFrame]:
    """The daily job: observe, append to the observation ``table``, then score what is there.

    ``all_scenes`` has area_km2 and cloud_fraction.  Returns the results of both passes; whatever starts
    it each day is outside.  A second run of a day appends nothing, and what other writers (a stream, a
    backfill) have appended is scored but not counted as written.  With ``months`` (:func:`features.months` of
    the table) what is new is folded into them, and scores read some 20 rows a lake, not all its observations.
    """
    known = observations.seeded(registry, lakes)
    rows, checked = _newest(known, scenes.latest_usable(all_scenes), all_scenes)
    _, results = _write(known, rows, checked, table, run_id("latest"), now)
    if months:
        months.refresh()
    seen = months.read() if months else table.read()
    return results, run_hazard(registry, lakes, static, seen, slope, as_of, exposure, now, bool(months))
