"""As-of merges of two tables, and the features of observation series on many days at once.

Both sides are put into one table and cut into blocks by key and month; a running value goes through
each block, and from block to block by a table of one row a block.  So the work is a sort of both
sides, however many days are asked for, and a key with a third of all rows is many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import features
from .observations import LOOKBACK


def _block(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def merge(requests: DataFrame, series: DataFrame, by: list[str], value: str, forward: bool = False, name: str | None = None, days: DataFrame | None = None, one_block: bool = False) -> DataFrame:
    """``requests`` with ``value`` of the row of ``series`` on or before ``day`` (``forward``: on or after it).

    Both have the columns ``by`` and ``day``; ``series`` has one row a key and day at most, and ``value``
    is a struct.  Null where there is none; requests with a null key or day have none.  ``days`` has the
    keys and days of the requests where these cost much to make, for the table of blocks; with
    ``one_block`` the key holds a month already, and there is none.
    """
    name = name or value
    sign = -1 if forward else 1
    rest = [c for c in requests.columns if c not in (*by, "day")]
    kind = series.schema[value].dataType
    asked = requests.select(*by, "day", F.lit(1).alias("_asks"), F.struct(*[F.col(c) for c in rest] or [F.lit(None).alias("_")]).alias("_request"), F.lit(None).cast(kind).alias("_value"))
    given = series.filter(F.col("day").isNotNull()).select(*by, "day", F.lit(0).alias("_asks"), F.lit(None).cast(asked.schema["_request"].dataType).alias("_request"), F.col(value).alias("_value"))
    both = asked.unionByName(given).withColumn("_block", sign * _block(F.col("day"))).withColumn("_at", sign * F.unix_date("day"))
    within = Window.partitionBy(*by, "_block").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumn("_run", F.last("_value", ignorenulls=True).over(within)).filter("_asks = 1")
    known = F.col("day").isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    out = [*by, "day", *[F.col(f"_request.{c}").alias(c) for c in rest]]
    if one_block:
        return run.select(*out, F.when(known, F.col("_run")).alias(name))
    # of each block the last value, and of these the last before a block
    keys = (requests if days is None else days).select(*by, (sign * _block(F.col("day"))).alias("_block"), F.lit(None).cast(f"struct<_at:int,_value:{kind.simpleString()}>").alias("_last"))
    ends = given.withColumns({"_block": sign * _block(F.col("day")), "_at": sign * F.unix_date("day")})
    last = keys.unionByName(ends.select(*by, "_block", F.struct("_at", "_value").alias("_last"))).groupBy(*by, "_block").agg(F.max("_last").alias("_last"))
    blocks = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, "_block", F.last("_last._value", ignorenulls=True).over(blocks).alias("_before"))
    right = carried.select(*[F.col(b).alias(f"_{b}_") for b in by], F.col("_block").alias("_block_"), "_before")
    on = F.col("_block").eqNullSafe(F.col("_block_"))
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}_"))
    return run.join(right, on, "left").select(*out, F.when(known, F.coalesce("_run", "_before")).alias(name))


def daily(observations: DataFrame) -> DataFrame:
    """(lake_id, day, of): of each lake's day the first observation, by source and scene."""
    first = F.min(F.struct("source", "scene_id", "area_km2"))
    rows = observations.groupBy("lake_id", F.col("captured_at").alias("day")).agg(first.alias("f"))
    return rows.select("lake_id", "day", F.struct(F.col("day").alias("at"), F.col("f.area_km2").alias("area")).alias("of"))


def _sums(observations: DataFrame) -> DataFrame:
    """(lake_id, year, month, day, of): of each day of a month the sum and number of areas up to that day."""
    days = observations.filter("area_km2 is not null").groupBy("lake_id", F.col("captured_at").alias("day")).agg(F.sum("area_km2").alias("s"), F.count(F.lit(1)).alias("n"))
    days = days.withColumns({"year": F.year("day"), "month": F.month("day")})
    upto = Window.partitionBy("lake_id", "year", "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("lake_id", "year", "month", "day", F.struct(F.sum("s").over(upto).alias("s"), F.sum("n").over(upto).alias("n")).alias("of"))


def history(observations: DataFrame, requests: DataFrame, windows: tuple[int, ...] = features.WINDOWS, tolerance: int = features.TOLERANCE_DAYS) -> DataFrame:
    """The columns of :func:`features.together` for every row of ``requests`` (lake_id, as_of), as seen on that
    day: no later observation counts, and none of more than LOOKBACK days before.

    A day's first observation by source and scene stands for it; of two as near the earlier one counts.
    The seasonal anomaly compares with the months of that name in earlier years, from the sums up to
    the ends of these months less those up to the first day that is looked back to.
    """
    series = daily(observations)
    asked = requests.select("lake_id", "as_of").distinct()
    day = F.col("as_of")
    # looking back: from the day itself, and from the days to compare with
    back = asked.select("lake_id", "as_of", F.explode(F.array(*[F.lit(w) for w in (0, *windows)])).alias("w"))
    back = back.withColumn("day", F.date_sub(day, F.col("w")))
    both = merge(merge(back, series, ["lake_id"], "of", name="before"), series, ["lake_id"], "of", forward=True, name="after", days=back)
    gap = lambda c: F.abs(F.datediff(F.col(f"{c}.at"), F.col("day")))
    usable = lambda c: (gap(c) <= tolerance) & (F.col(f"{c}.at") <= day)
    near = F.when(usable("before") & ~F.coalesce(usable("after") & (gap("after") < gap("before")), F.lit(False)), F.col("before")).when(usable("after"), F.col("after"))
    latest = F.when(F.datediff(day, F.col("before.at")) <= LOOKBACK, F.col("before"))
    chosen = both.withColumn("of", F.when(F.col("w") == 0, latest).otherwise(near))
    pick = lambda w: F.max(F.when(F.col("w") == w, F.col("of"))).alias(f"p{w}")
    wide = chosen.groupBy("lake_id", "as_of").agg(*[pick(w) for w in (0, *windows)])
    # months of the latest observation's name in earlier years that the lookback reaches
    since, points = F.date_sub(day, LOOKBACK), [f"p{w}" for w in (0, *windows)]
    years = F.filter(F.sequence(F.year("p0.at") - (LOOKBACK // 365 + 1), F.year("p0.at") - 1), lambda y: F.last_day(F.make_date(y, F.month("p0.at"), F.lit(1))) >= since)
    months = wide.select("lake_id", "as_of", *points, F.month("p0.at").alias("month"), F.explode_outer(years).alias("year"))
    first = F.make_date("year", "month", F.lit(1))
    ends = months.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    ends = ends.withColumn("day", F.when(F.col("sign") == 1, F.last_day(first)).when(since > first, F.date_sub(since, 1)))
    sums = merge(ends, _sums(observations), ["lake_id", "year", "month"], "of", one_block=True)
    of = lambda x, zero: F.sum(F.col("sign") * F.coalesce(F.col(f"of.{x}"), F.lit(zero))).alias(x)
    out = sums.groupBy("lake_id", "as_of").agg(*[F.first(p).alias(p) for p in points], of("s", 0.0), of("n", 0))
    change = lambda new, old: F.try_divide(new - old, old)
    rates = [change(F.col("p0.area"), F.col(f"p{w}.area")).alias(f"growth_{w}") for w in windows]
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    return out.select("lake_id", "as_of", F.col("p0.at").alias("latest_at"), F.col("p0.area").alias("latest_km2"), *rates, change(F.col("p0.area"), mean).alias("anomaly"))
