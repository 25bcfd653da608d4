"""Scene selection: candidates, usable scenes, one observation a lake, day and source.

Scenes have lake_id, scene_id, acquired_at, source, cloud_cover_pct and cloud_fraction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strict limit of the catalogue search, share of hidden pixels that still passes, candidates a lake.
MAX_SCENE_CLOUD, MAX_CLOUD_FRACTION, CANDIDATES = 80.0, 0.5, 12


def _newest(*by: str) -> Window:
    return Window.partitionBy(*by).orderBy(F.desc("acquired_at"), F.desc("scene_id"))


def searched(scenes: DataFrame, lakes: list | None = None) -> DataFrame:
    """Scenes under the catalogue's cloud limit (a missing figure fails it), of some lakes or all."""
    found = scenes.filter(F.col("cloud_cover_pct") < MAX_SCENE_CLOUD)
    return found.filter(F.col("lake_id").isin(lakes)) if lakes else found


def with_cloud_default(scenes: DataFrame) -> DataFrame:
    """A missing figure reads as 100; apply after :func:`searched`."""
    return scenes.withColumn("cloud_cover_pct", F.coalesce("cloud_cover_pct", F.lit(100.0)))


def candidates(scenes: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The newest scenes of each lake with their ``rank``; Spark limits each group before the shuffle."""
    return searched(scenes).withColumn("rank", F.row_number().over(_newest("lake_id"))).filter(F.col("rank") <= limit)


def in_range(scenes: DataFrame, start: str, end: str) -> DataFrame:
    """Scenes from day ``start`` to day ``end``, both included; the filter reaches the scan."""
    first, after = F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), 1)
    return searched(scenes).filter((F.col("acquired_at") >= first) & (F.col("acquired_at") < after))


def is_usable(cloud_fraction: Column) -> Column:
    return cloud_fraction <= MAX_CLOUD_FRACTION


def _measured(scenes: DataFrame) -> list[str]:
    """What a scene's pixels gave, where ``scenes`` has it."""
    return [c for c in ("area_km2", "cloud_fraction") if c in scenes.columns]


def _fault(scenes: DataFrame) -> Column:
    """Why a scene can't be read (see :func:`checked` and :func:`processed`), null if it can."""
    return F.col("fault") if "fault" in scenes.columns else F.lit(None).cast("string")


def checked(raw: DataFrame) -> DataFrame:
    """Scenes as a catalogue gives them, with acquired_at and cloud_cover_pct perhaps as text: these two as
    values, and ``fault``, which names a text that is none.  No malformed value fails the job."""
    day, pct = F.col("acquired_at").try_cast("timestamp_ntz"), F.col("cloud_cover_pct").try_cast("double")
    bad = lambda name, value: F.when(F.col(name).isNotNull() & value.isNull(), F.concat(F.lit(f"malformed {name}: "), F.col(name).cast("string")))
    fault = F.coalesce(bad("acquired_at", day), bad("cloud_cover_pct", pct))
    return raw.withColumn("fault", fault).withColumns({"acquired_at": day, "cloud_cover_pct": pct})


def lost(scenes: DataFrame) -> DataFrame:
    """(lake_id, error): lakes of which a scene has no place in the order of their scenes, since its date
    or its cloud figure is malformed; what the search of such a lake gives is not known."""
    unplaced = _fault(scenes).isNotNull() & (F.col("acquired_at").isNull() | F.col("cloud_cover_pct").isNull())
    return scenes.filter(unplaced).groupBy("lake_id").agg(F.min(_fault(scenes)).alias("error"))


def latest_usable(scenes: DataFrame) -> DataFrame:
    """One row a lake with candidates: its newest usable one (nulls if none) and scenes_checked.

    Checking stops at the first usable scene, so its rank is the number checked.  Where ``scenes`` has
    ``fault``, it also stops at the first scene that has one, which is the lake's ``error``.
    """
    ok, more = is_usable(F.col("cloud_fraction")), _measured(scenes)
    faults = ["fault"] if "fault" in scenes.columns else []
    stop = ok | _fault(scenes).isNotNull()
    first = F.min(F.when(stop, F.struct("rank", "scene_id", "acquired_at", "source", *more, *faults)))
    found = candidates(scenes).groupBy("lake_id").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    good = F.col("f.fault").isNull() if faults else F.lit(True)
    of = lambda c: F.when(good, F.col(f"f.{c}")).alias(c)
    error = [F.col("f.fault").alias("error")] if faults else []
    return found.select("lake_id", of("scene_id"), of("acquired_at"), of("source"), F.coalesce("f.rank", "n").cast("long").alias("scenes_checked"), *[of(c) for c in more], *error)


#: Ranks of candidates whose pixels are read together, wave by wave.
WAVES = (1, 1, 2, 4, 4)


def latest_in_waves(scenes: DataFrame, pixels: DataFrame, store: Callable[[DataFrame, str], DataFrame], waves: tuple[int, ...] = WAVES) -> DataFrame:
    """:func:`latest_usable` where cloud and water are still in the pixels: the same rows, with error.

    Most lakes need one scene.  Each wave reads the pixels of the next candidates of those lakes that have
    no usable scene yet; the scenes of a wave meet the pixels in a join that prunes their scan.  ``store``
    writes a table and reads it again, which lets a wave's size be known before its pixels are read.
    """
    rest = [c for c in ("scene_id", "acquired_at", "source", "fault") if c in scenes.columns]
    open_ = store(candidates(scenes, sum(waves)).select("lake_id", "rank", *rest), "candidates")
    counts = open_.groupBy("lake_id").agg(F.count(F.lit(1)).alias("n"))
    done, upto = [], 0
    for k, width in enumerate(waves):
        wave = open_.filter((F.col("rank") > upto) & (F.col("rank") <= upto + width))
        upto += width
        if wave.isEmpty():
            break
        # a join key as in the pixels' files: their row groups are skipped by its range
        ids = wave.agg(F.min("scene_id").alias("a"), F.max("scene_id").alias("b")).first()
        near = pixels.filter(F.col("scene_id").between(F.lit(ids["a"]), F.lit(ids["b"])))
        read = store(processed(wave, near.join(wave.select("scene_id").distinct(), "scene_id", "left_semi")), f"wave-{k}")
        stop = is_usable(F.col("cloud_fraction")) | F.col("fault").isNotNull()
        best = F.min(F.when(stop, F.struct("rank", "scene_id", "acquired_at", "source", "area_km2", "cloud_fraction", "fault")))
        done.append(read.groupBy("lake_id").agg(best.alias("f")).filter("f is not null"))
        if upto < sum(waves):
            open_ = store(open_.filter(F.col("rank") > upto).join(done[-1].select("lake_id"), "lake_id", "left_anti"), f"open-{k}")
    found = done[0] if done else counts.select("lake_id", F.lit(None).cast("struct<rank:int,scene_id:long,acquired_at:timestamp_ntz,source:string,area_km2:double,cloud_fraction:double,fault:string>").alias("f")).filter("false")
    for more in done[1:]:
        found = found.unionByName(more)
    of = lambda c: F.when(F.col("f.fault").isNull(), F.col(f"f.{c}")).alias(c)
    out = counts.join(found, "lake_id", "left")
    return out.select("lake_id", of("scene_id"), of("acquired_at"), of("source"), F.coalesce("f.rank", "n").cast("long").alias("scenes_checked"), of("area_km2"), of("cloud_fraction"), F.col("f.fault").alias("error"))


def before_fault(scenes: DataFrame) -> DataFrame:
    """Scenes that are checked, newest first, up to the first of a lake with a fault, which is among them."""
    if "fault" not in scenes.columns:
        return scenes
    first = F.max(F.when(F.col("fault").isNotNull(), F.struct("acquired_at", "scene_id")))
    faults = scenes.groupBy("lake_id").agg(first.alias("_at")).filter("_at is not null")
    return scenes.join(faults, "lake_id", "left").filter(F.col("_at").isNull() | (F.struct("acquired_at", "scene_id") >= F.col("_at"))).drop("_at")


def first_of_day(scenes: DataFrame) -> DataFrame:
    """Usable scenes, one a lake, day and source: the newest, as the first that is written stays, with what
    its pixels gave."""
    more = _measured(scenes)
    ok = scenes.filter(is_usable(F.col("cloud_fraction")) & _fault(scenes).isNull()).withColumn("captured_at", F.to_date("acquired_at"))
    best = F.max(F.struct("acquired_at", "scene_id", *more))
    return ok.groupBy("lake_id", "captured_at", "source").agg(best.alias("b")).select("lake_id", "captured_at", "source", *[F.col(f"b.{c}").alias(c) for c in ("scene_id", *more)])


def process(pixels: DataFrame, *keys: str) -> DataFrame:
    """Scene processing: one pass over (keys, green, nir, scene_class) gives area, cloud fraction, and how
    many pixels have a value that is no number, where bands come as text."""
    from ..functions import pixels as px

    bands = {c: F.col(c).try_cast(t) for c, t in (("green", "double"), ("nir", "double"), ("scene_class", "int")) if dict(pixels.dtypes)[c] == "string"}
    odd = F.lit(False)
    for c, value in bands.items():
        odd = odd | (F.col(c).isNotNull() & value.isNull())
    pixels = pixels.withColumn("_odd", odd).withColumns(bands)
    mask = px.usable(F.col("scene_class"))
    wet = px.is_water(px.water_index(F.col("green"), F.col("nir")), mask)
    more = [F.count_if("_odd").alias("n_malformed")] if bands else []
    return pixels.groupBy(*keys).agg(px.water_area_km2(wet).alias("area_km2"), px.cloud_fraction(mask).alias("cloud_fraction"), *more)


def processed(scenes: DataFrame, pixels: DataFrame) -> DataFrame:
    """``scenes`` (scene_id, ...) with area_km2 and cloud_fraction of their pixels, and ``fault``; a scene
    without any has no water and is all cloud, one with malformed pixels has a fault."""
    found = scenes.join(process(pixels, "scene_id"), "scene_id", "left")
    malformed = F.when(F.col("n_malformed") > 0, F.format_string("malformed pixels: %d", "n_malformed")) if "n_malformed" in found.columns else F.lit(None).cast("string")
    filled = {"area_km2": F.coalesce("area_km2", F.lit(0.0)), "cloud_fraction": F.coalesce("cloud_fraction", F.lit(1.0)), "fault": F.coalesce(_fault(scenes), malformed)}
    return found.withColumns(filled).drop("n_malformed")
