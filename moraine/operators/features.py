"""Growth and seasonal features of observation series (lake_id, captured_at, source, scene_id, area_km2).

As-of lookups are aggregates over structs: one shuffle on the lake, combined before it, and ties
resolved by the order of the series (day, source, scene).  :func:`from_months` takes them from a
summary by lake and month that new observations are folded into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable, Rollup
from .observations import LOOKBACK

TOLERANCE_DAYS = 15
WINDOWS = (30, 90)


def latest(as_of: Column) -> Column:
    """Aggregate: the last day on or before ``as_of``, of that day the first row."""
    age = F.datediff(as_of, F.col("captured_at"))
    return F.min(F.when(age >= 0, F.struct(age.alias("age"), "source", "scene_id", "captured_at", "area_km2")))


def nearest(target: Column, tolerance: int = TOLERANCE_DAYS) -> Column:
    """Aggregate: the row nearest to ``target`` within ``tolerance`` days, the earlier of two."""
    gap = F.abs(F.datediff(F.col("captured_at"), target))
    return F.min(F.when(gap <= tolerance, F.struct(gap.alias("gap"), "captured_at", "source", "scene_id", "area_km2")))


def _change(new: Column, old: Column) -> Column:
    """(new - old) / old; null where old is missing or 0."""
    return F.try_divide(new - old, old)


def growth(observations: DataFrame, as_of: str, windows: tuple[int, ...] = WINDOWS, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """lake_id, latest_at, latest_km2 and growth_N for each window of N days before ``as_of``."""
    day = F.lit(as_of).cast("date")
    found = observations.groupBy("lake_id").agg(latest(day).alias("l"), *[nearest(F.date_sub(day, w), tolerance).alias(f"p{w}") for w in windows])
    rates = [_change(F.col("l.area_km2"), F.col(f"p{w}.area_km2")).alias(f"growth_{w}") for w in windows]
    return found.select("lake_id", F.col("l.captured_at").alias("latest_at"), F.col("l.area_km2").alias("latest_km2"), *rates)


def seasonal_anomaly(observations: DataFrame, as_of: str) -> DataFrame:
    """lake_id, anomaly: the latest area against the mean of that month in other years."""
    day = F.lit(as_of).cast("date")
    last = observations.groupBy("lake_id").agg(latest(day).alias("l")).select("lake_id", F.col("l.captured_at").alias("at"), F.col("l.area_km2").alias("area"))
    # by lake and calendar month first, so that what is joined to the latest row is 12 rows a lake and year
    months = observations.groupBy("lake_id", F.year("captured_at").alias("y"), F.month("captured_at").alias("m")).agg(F.sum("area_km2").alias("s"), F.count("area_km2").alias("n"))
    same = (F.col("m") == F.month("at")) & (F.col("y") != F.year("at"))
    found = months.join(last, "lake_id").groupBy("lake_id").agg(F.first("area").alias("area"), F.sum(F.when(same, F.col("s"))).alias("s"), F.sum(F.when(same, F.col("n"))).alias("n"))
    return found.select("lake_id", _change(F.col("area"), F.try_divide("s", "n")).alias("anomaly"))


def together(observations: DataFrame, as_of: str, windows: tuple[int, ...] = WINDOWS, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """The columns of :func:`growth` and :func:`seasonal_anomaly` from one pass over the series.

    Rows are first combined by lake and calendar month; of these few a lake has the latest and nearest
    rows are taken again, and the months of the latest row's name in other years added up.
    """
    day = F.lit(as_of).cast("date")
    ends = {"l": latest(day)} | {f"p{w}": nearest(F.date_sub(day, w), tolerance) for w in windows}
    monthly = observations.groupBy("lake_id", F.year("captured_at").alias("y"), F.month("captured_at").alias("m")).agg(
        *[c.alias(name) for name, c in ends.items()], F.sum("area_km2").alias("s"), F.count("area_km2").alias("n")
    )
    return _of_months(monthly, windows)


def _of_months(monthly: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """:func:`together` of rows a lake and month: y, m, the latest and nearest rows in it, sum and number of areas."""
    ends = ["l", *(f"p{w}" for w in windows)]
    found = monthly.groupBy("lake_id").agg(*[F.min(name).alias(name) for name in ends], F.collect_list(F.struct("y", "m", "s", "n")).alias("months"))
    at = F.col("l.captured_at")
    same = F.filter("months", lambda x: (x["m"] == F.month(at)) & (x["y"] != F.year(at)))
    total = lambda name, zero: F.aggregate(same, zero, lambda a, x: a + F.coalesce(x[name], zero))
    mean = F.try_divide(total("s", F.lit(0.0)), total("n", F.lit(0).cast("long")))
    rates = [_change(F.col("l.area_km2"), F.col(f"p{w}.area_km2")).alias(f"growth_{w}") for w in windows]
    return found.select("lake_id", at.alias("latest_at"), F.col("l.area_km2").alias("latest_km2"), *rates, _change(F.col("l.area_km2"), mean).alias("anomaly"))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


#: A lake's month: of each of its days the first observation by source and scene, the sum and number of areas.
MONTHS = "lake_id long, month int, days array<struct<day: date, first: struct<source: string, scene_id: {scene_id}, area_km2: double>, s: double, n: long>>"


def by_month(observations: DataFrame) -> DataFrame:
    """The rows of MONTHS for some observations; those without a day are in no month."""
    first = F.min(F.struct("source", "scene_id", "area_km2"))
    days = observations.filter("captured_at is not null").groupBy("lake_id", F.col("captured_at").alias("day"))
    days = days.agg(first.alias("first"), F.sum("area_km2").alias("s"), F.count("area_km2").alias("n"))
    return days.groupBy("lake_id", _month(F.col("day")).alias("month")).agg(F.collect_list(F.struct("day", "first", "s", "n")).alias("days"))


def merge_months(parts: DataFrame) -> DataFrame:
    """One row a lake and month of the rows of several parts of the observations."""
    days = parts.select("lake_id", "month", F.explode("days").alias("d")).groupBy("lake_id", "month", "d.day")
    days = days.agg(F.min("d.first").alias("first"), F.sum("d.s").alias("s"), F.sum("d.n").alias("n"))
    return days.groupBy("lake_id", "month").agg(F.collect_list(F.struct("day", "first", "s", "n")).alias("days"))


def months(observations: KeyedTable, path: str) -> Rollup:
    """The months of an observation table, kept at ``path``; a refresh folds what was appended since the last."""
    scene = observations.schema["scene_id"].dataType.simpleString()
    return Rollup(observations, path, MONTHS.format(scene_id=scene), by_month, merge_months)


def from_months(rows: DataFrame, as_of: str, strict: bool = False, windows: tuple[int, ...] = WINDOWS, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """The columns of :func:`together`, over the lookback of :func:`observations.lookback`, from a lake's months.

    Months before the lookback (with ``strict``, after ``as_of`` too) are not read.  Each day has kept the
    row that a lookup could choose of it, so the results are those of the observations themselves.
    """
    day = F.lit(as_of).cast("date")
    since = F.date_sub(day, LOOKBACK)
    inside = lambda d: (d["day"] >= since) & (d["day"] <= day) if strict else d["day"] >= since
    reach = F.col("month") >= _month(since)
    if strict:
        reach = reach & (F.col("month") <= _month(day))
    seen = rows.filter(reach).withColumn("days", F.filter("days", inside)).filter(F.size("days") > 0)

    def chosen(count: Callable, reach: Callable, order: list[str]) -> Column:
        """Of a month's days within reach the least, in the order in which the lookups of whole series take them."""
        value = {"age": count, "gap": count, "captured_at": lambda d: d["day"]} | {c: lambda d, c=c: d["first"][c] for c in ("source", "scene_id", "area_km2")}
        return F.array_min(F.transform(F.filter("days", lambda d: reach(count(d))), lambda d: F.struct(*[value[c](d).alias(c) for c in order])))

    ends = {"l": chosen(lambda d: F.datediff(day, d["day"]), lambda n: n >= 0, ["age", "source", "scene_id", "captured_at", "area_km2"])}
    for w in windows:
        gap = lambda d, w=w: F.abs(F.datediff(d["day"], F.date_sub(day, w)))
        ends[f"p{w}"] = chosen(gap, lambda n: n <= tolerance, ["gap", "captured_at", "source", "scene_id", "area_km2"])
    total = lambda c, zero: F.aggregate("days", zero, lambda a, d: a + F.coalesce(d[c], zero))
    monthly = seen.select(
        "lake_id", F.floor(F.col("month") / 12).cast("int").alias("y"), (F.col("month") % 12 + 1).alias("m"), *[c.alias(name) for name, c in ends.items()],
        total("s", F.lit(0.0)).alias("s"), total("n", F.lit(0).cast("long")).alias("n"),
    )
    return _of_months(monthly, windows)
