"""Registered queries over the given tables, each with the SQL that must give the same rows.

The SQL is written from the definitions, apart from the DataFrame code.  Doubles are rounded to
six places on both sides; tiers come from the score before rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, pixels as px, risk
from ..operators import asof, features, hazard, observations as ob, scenes as sc, terrain
from ..sources import stand_in as src
from ..sources.scratch import Scratch
from . import runs

AS_OF, NOW = src.AS_OF, src.NOW
RANGE = ("2024-01-05", "2024-01-20")
RUN_AT = "2024-03-25 00:00:00"


def _r(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places)


def water_index(s: SparkSession, d: str) -> DataFrame:
    i = px.water_index(F.col("green"), F.col("nir"))
    return src.pixels(s, d).select("scene_id", "green", "nir", i.cast("double").alias("ndwi"))


def usable_mask_counts(s: SparkSession, d: str) -> DataFrame:
    return src.pixels(s, d).groupBy("scene_class", px.usable(F.col("scene_class")).alias("usable")).agg(F.count(F.lit(1)).alias("n"))


def encoded_dn(s: SparkSession, d: str) -> DataFrame:
    return src.table(s, d, "lineitem").groupBy(px.encode_dn(F.col("l_discount")).alias("dn"), px.encode_dn(F.col("l_quantity") + 0.5).alias("dn_large")).agg(F.count(F.lit(1)).alias("n"))


def scene_water_area(s: SparkSession, d: str) -> DataFrame:
    done = sc.process(src.pixels(s, d), "scene_id")
    return done.select("scene_id", _r("area_km2").alias("area_km2"), _r("cloud_fraction").alias("cloud_fraction"), sc.is_usable(F.col("cloud_fraction")).alias("accepted"))


def scene_candidates_top12(s: SparkSession, d: str) -> DataFrame:
    return sc.with_cloud_default(sc.candidates(src.scenes(s, d))).select("lake_id", "scene_id", "rank", _r("cloud_cover_pct").alias("cloud_cover_pct"))


def scenes_in_range(s: SparkSession, d: str) -> DataFrame:
    lo, hi = RANGE
    return sc.in_range(src.scenes(s, d), lo, hi).select("lake_id", "scene_id", F.to_date("acquired_at").alias("captured_at"))




def latest_usable_scene(s: SparkSession, d: str) -> DataFrame:
    return sc.latest_usable(src.scenes(s, d)).select("lake_id", "scene_id", "scenes_checked")


def observation_dedupe(s: SparkSession, d: str) -> DataFrame:
    found = sc.first_of_day(sc.searched(src.scenes(s, d)))
    return found.select("lake_id", F.to_timestamp_ntz(F.col("captured_at").cast("string")).alias("captured_at"), "source", "scene_id")


def observation_new_rows(s: SparkSession, d: str) -> DataFrame:
    obs = src.observations(s, d)
    return ob.new_rows(obs, obs.filter("scene_id % 2 = 0")).select("lake_id", "captured_at", "source", "scene_id", "area_km2")


def lake_staleness(s: SparkSession, d: str) -> DataFrame:
    lakes = src.table(s, d, "customer").select(F.col("c_custkey").alias("lake_id"))
    return ob.status(lakes, src.observations(s, d, "c_custkey"), NOW)


def lake_seed_check(s: SparkSession, d: str) -> DataFrame:
    registry, lakes, _ = src.customer_lakes(s, d)
    return ob.seeded(registry, lakes).select("slug", "ordinal", "lake_id", "error")


def obs_lookback(s: SparkSession, d: str) -> DataFrame:
    found = ob.lookback(src.observations(s, d), AS_OF)
    return found.groupBy("lake_id").agg(F.count(F.lit(1)).alias("n"), F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))


def latest_as_of(s: SparkSession, d: str) -> DataFrame:
    found = src.observations(s, d).groupBy("lake_id").agg(features.latest(F.lit(AS_OF).cast("date")).alias("l"))
    return found.select("lake_id", "l.captured_at", "l.scene_id", "l.area_km2")


def nearest_within_15d(s: SparkSession, d: str) -> DataFrame:
    near = lambda w: features.nearest(F.date_sub(F.lit(AS_OF).cast("date"), w))
    found = ob.lookback(src.observations(s, d), AS_OF).groupBy("lake_id").agg(near(30).alias("a"), near(90).alias("b"))
    return found.select("lake_id", F.col("a.scene_id").alias("scene_30"), F.col("a.captured_at").alias("at_30"), F.col("b.scene_id").alias("scene_90"), F.col("b.captured_at").alias("at_90"))


def growth_30_90(s: SparkSession, d: str) -> DataFrame:
    found = features.growth(ob.lookback(src.observations(s, d), AS_OF), AS_OF)
    return found.select("lake_id", "latest_at", *[_r(f"growth_{w}").alias(f"growth_{w}") for w in features.WINDOWS])


def seasonal_anomaly(s: SparkSession, d: str) -> DataFrame:
    found = features.seasonal_anomaly(ob.lookback(src.observations(s, d), AS_OF), AS_OF)
    return found.select("lake_id", _r("anomaly").alias("anomaly"))


def dam_type_risk(s: SparkSession, d: str) -> DataFrame:
    lakes = src.table(s, d, "customer").select(F.col("c_custkey").alias("lake_id"), src.dam_type(F.col("c_nationkey")).alias("dam_type"))
    return lakes.select("lake_id", risk.dam_risk(F.col("dam_type")).alias("risk"), risk.dam_recognised(F.col("dam_type")).alias("recognised"))


def _hazard(s: SparkSession, d: str) -> DataFrame:
    return hazard.risks(hazard.inputs(src.lakes(s, d), src.observations(s, d), terrain.mean_slope(src.elevation(s, d)), AS_OF))


def normalized_risks(s: SparkSession, d: str) -> DataFrame:
    return _hazard(s, d).select("lake_id", *[_r(f"risk_{k}").alias(k) for k in hazard.RISKS])


def hazard_score_tier(s: SparkSession, d: str) -> DataFrame:
    return _hazard(s, d).select("lake_id", "slug", _r("score").alias("score"), "tier")


def hazard_components(s: SparkSession, d: str) -> DataFrame:
    """Read back from the JSON document."""
    c = lambda path: F.get_json_object("components", f"$.{path}")
    num = lambda path: _r(c(path).cast("double"))
    return hazard.components(_hazard(s, d), AS_OF).select(
        "lake_id", c("methodology_version").alias("version"), c("as_of").alias("as_of"), num("weights.area_growth").alias("w_growth"), num("tier_thresholds[1][0]").alias("t_high"),
        num("raw_inputs.growth_30d_pct").alias("growth_30"), c("raw_inputs.dam_type").alias("dam_type"), num("normalized_risks.slope").alias("slope_risk"), c("exposure").isNull().alias("no_exposure"),
    )


def terrain_slope(s: SparkSession, d: str) -> DataFrame:
    return terrain.mean_slope(src.elevation(s, d)).select("lake_id", _r("slope_degrees").alias("slope_degrees"))


def pixel_metres(s: SparkSession, d: str) -> DataFrame:
    at = src.placed(src.table(s, d, "customer"), "c_custkey")
    m = geo.pixel_metres(F.lit(0.0002), F.lit(-0.0002), F.col("lat"))
    return at.select("c_custkey", _r(m["dx_m"]).alias("dx_m"), _r(m["dy_m"]).alias("dy_m"))


def exposure_population(s: SparkSession, d: str) -> DataFrame:
    lakes = src.placed(src.table(s, d, "embeddings").select(F.col("vec_id").alias("lake_id")), "lake_id")
    found = terrain.exposure(lakes, src.population(s, d), 5.0)
    return found.select("lake_id", _r("population", 3).alias("population"))


def aoi_bbox_grid(s: SparkSession, d: str) -> DataFrame:
    at = src.placed(src.table(s, d, "customer"), "c_custkey")
    b = at.select("c_custkey", geo.box(F.col("lon"), F.col("lat"), F.lit(0.01)).alias("b"))
    return b.select("c_custkey", *[_r(f"b.{x}").alias(x) for x in ("west", "south", "east", "north")], geo.grid_size(F.col("b"))["width"].alias("width"), geo.grid_size(F.col("b"))["height"].alias("height"))


def band_align_upsample(s: SparkSession, d: str) -> DataFrame:
    """A band at half the resolution (means of 2 x 2 cells) beside the whole grid."""
    fine, half = src.grid(s, d), lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    coarse = fine.groupBy("lake_id", half("row"), half("col")).agg(F.avg("v").alias("scl"))
    return terrain.align(fine, coarse, ["lake_id"]).select("lake_id", "row", "col", _r("v").alias("v"), _r("scl").alias("scl"))


def bbox_candidates(s: SparkSession, d: str) -> DataFrame:
    """Lakes' boxes against scenes' boxes: by cells that both overlap, each pair once."""
    half = F.lit(0.05)
    lakes = src.placed(src.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("lake_id")), "lake_id").select("lake_id", geo.box(F.col("lon"), F.col("lat"), half).alias("box"))
    other = src.placed(src.table(s, d, "customer").select(F.col("c_custkey").alias("scene_id")), "scene_id").select("scene_id", geo.box(F.col("lon"), F.col("lat"), half).alias("box"))
    return terrain.boxes_meet(lakes, other.withColumnRenamed("box", "other")).select("lake_id", "scene_id")


def _mixed_boxes(s: SparkSession, d: str) -> DataFrame:
    """Boxes around customers' places, of half widths from 0.002 to 2 degrees."""
    at = src.placed(src.table(s, d, "customer").select(F.col("c_custkey").alias("lake_id")), "lake_id")
    wide = F.lit(0.002) * F.pow(F.lit(10.0), F.when(F.col("lake_id") % 100 == 0, 3).otherwise(F.col("lake_id") % 3))
    return at.select("lake_id", geo.box(F.col("lon"), F.col("lat"), wide).alias("box"))


def mixed_boxes_meet(s: SparkSession, d: str) -> DataFrame:
    """Boxes of a village next to boxes of a country, against boxes around suppliers: pairs that overlap."""
    other = src.placed(src.table(s, d, "supplier").select(F.col("s_suppkey").alias("scene_id")), "scene_id").select("scene_id", geo.box(F.col("lon"), F.col("lat"), F.lit(0.03)).alias("other"))
    return terrain.boxes_meet(_mixed_boxes(s, d), other).select("lake_id", "scene_id")


def population_by_place(s: SparkSession, d: str) -> DataFrame:
    """People in boxes of mixed size, from a table laid out by place, of which the zones of the boxes are read."""
    path = f"{Scratch(s, 'places').path}/population"
    terrain.write_by_place(src.population(s, d), path)
    boxes = _mixed_boxes(s, d)
    found = boxes.join(terrain.totals_by_place(boxes, s.read.parquet(path)), "box")
    return found.groupBy("lake_id").agg(F.sum("n").alias("n_cells"), _r(F.sum("p"), 3).alias("population"))


def run_summary(s: SparkSession, d: str) -> DataFrame:
    """A backfill over all days for all lakes that have scenes."""
    every = src.scenes(s, d)
    registry = every.select(F.col("lake_id").cast("string").alias("slug"), F.col("lake_id").alias("ordinal")).distinct()
    lakes = registry.select("slug", F.col("ordinal").alias("lake_id"))
    none = s.createDataFrame([], "lake_id long, captured_at date, source string")
    _, results = runs.run_backfill(registry, lakes, every, none, "1900-01-01", "2100-01-01")
    return runs.summary(results)


def run_latest(s: SparkSession, d: str) -> DataFrame:
    """All customers as registry, those with scenes as seeded; what was written before RANGE ends is there."""
    every = src.scenes(s, d)
    registry = src.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_custkey").alias("ordinal"))
    lakes = every.select(F.col("lake_id").cast("string").alias("slug"), "lake_id").distinct()
    existing = sc.first_of_day(sc.in_range(every, "1900-01-01", RANGE[1]))
    _, results = runs.run_latest(registry, lakes, every, existing, RUN_AT)
    return results


def _hazard_run(s: SparkSession, d: str) -> DataFrame:
    """Customers as lakes: some not seeded, some without a static row, some without elevation."""
    registry, lakes, static = src.customer_lakes(s, d)
    people = terrain.exposure(src.placed(static.select("lake_id"), "lake_id"), src.population(s, d), terrain.BUFFER_KM)
    return runs.run_hazard(registry, lakes, static, src.observations(s, d, "c_custkey"), terrain.mean_slope(src.elevation(s, d)), AS_OF, people, NOW)


def run_hazard(s: SparkSession, d: str) -> DataFrame:
    done = _hazard_run(s, d)
    c = lambda path: F.get_json_object("components", f"$.{path}")
    return done.select(
        "ordinal", "slug", "lake_id", _r("score").alias("score"), "tier", F.col("computed_at").isNotNull().alias("computed"), "error", _r(c("raw_inputs.slope_deg").cast("double")).alias("slope_deg"),
        c("exposure.population_within_buffer").cast("double").alias("people"), c("exposure.buffer_shape").alias("shape"), c("tier_thresholds[3][1]").alias("lowest"),
    )


def score_reports(s: SparkSession, d: str) -> DataFrame:
    return runs.score_reports(_hazard_run(s, d), "hazard-1").select("lakeId", "runId", _r("score").alias("score"), "tier", "computedAt", F.get_json_object("components", "$.as_of").alias("as_of"))


def lake_elevation(s: SparkSession, d: str) -> DataFrame:
    """Boxes around places between the tiles: of overlapping tiles the first one's cells."""
    return terrain.lake_elevation(*_tiled_lakes(s, d), src.CELL).select("lake_id", "row", "col", _r("z").alias("z"))


def _tiled_lakes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tiles, cells = src.elevation_tiles(s, d)
    at = tiles.select(F.col("tile").alias("lake_id"), (F.col("box.west") + 0.006).alias("lon"), (F.col("box.south") + 0.006).alias("lat"))
    return at.select("lake_id", geo.box(F.col("lon"), F.col("lat"), F.lit(0.0075)).alias("box")), tiles, cells


def lake_slopes(s: SparkSession, d: str) -> DataFrame:
    """Slopes of the lakes of :func:`lake_elevation`, a row of a tile an array."""
    return terrain.lake_slopes(*_tiled_lakes(s, d), src.CELL).select("lake_id", _r("slope_degrees").alias("slope_degrees"))


def scene_processing(s: SparkSession, d: str) -> DataFrame:
    """Orders as scenes; some have no pixels."""
    done = sc.processed(src.table(s, d, "orders").select(F.col("o_orderkey").alias("scene_id")), src.pixels(s, d))
    return done.select("scene_id", _r("area_km2").alias("area_km2"), _r("cloud_fraction").alias("cloud_fraction"), sc.is_usable(F.col("cloud_fraction")).alias("accepted"))


def backfill_rows(s: SparkSession, d: str) -> DataFrame:
    """What a backfill of all days writes: orders as scenes of their customers, with what their pixels gave."""
    every = sc.processed(src.order_scenes(s, d), src.pixels(s, d))
    registry, lakes, _ = src.customer_lakes(s, d)
    none = s.createDataFrame([], "lake_id long, captured_at date, source string")
    rows, _ = runs.run_backfill(registry, lakes, every, none, "1900-01-01", "2100-01-01", run="backfill")
    return rows.select("lake_id", "captured_at", "source", "scene_id", _r("area_km2").alias("area_km2"), _r("cloud_fraction").alias("cloud_fraction"), F.col("row_id").isNotNull().alias("has_id"), "run_id")


def latest_from_pixels(s: SparkSession, d: str) -> DataFrame:
    """The newest usable scene of each customer, whose orders are scenes: pixels are read wave by wave."""
    found = sc.latest_in_waves(src.order_scenes(s, d), src.pixels(s, d), Scratch(s, "waves"))
    return found.select("lake_id", "scene_id", "scenes_checked", _r("area_km2").alias("area_km2"), _r("cloud_fraction").alias("cloud_fraction"), "error")


def run_latest_with_faults(s: SparkSession, d: str) -> DataFrame:
    """Scenes and pixels as text, some malformed: error rows of their lakes, results of the others."""
    raw, bands = src.raw_scenes(s, d)
    every = sc.processed(sc.checked(raw), bands)
    registry = src.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("slug"), F.col("c_custkey").alias("ordinal"))
    lakes = registry.select("slug", F.col("ordinal").alias("lake_id"))
    none = s.createDataFrame([], "lake_id long, captured_at date, source string")
    _, results = runs.run_latest(registry, lakes, every, none, NOW)
    return results


def growth_history(s: SparkSession, d: str) -> DataFrame:
    """Features of every lake on every day from its first observation to its last, as seen on that day."""
    seen = src.observations(s, d)
    ends = seen.groupBy("lake_id").agg(F.min("captured_at").alias("first"), F.max("captured_at").alias("last"))
    asked = ends.select("lake_id", F.explode(F.sequence("first", "last")).alias("as_of"))
    found = asof.history(seen, asked)
    return found.select("lake_id", "as_of", "latest_at", "latest_km2", *[_r(f"growth_{w}").alias(f"growth_{w}") for w in features.WINDOWS], _r("anomaly").alias("anomaly"))


def features_by_month(s: SparkSession, d: str) -> DataFrame:
    """Growth and anomaly from months that three appends were folded into: the rows of even years, of odd
    years, and the first source's, which come late."""
    scratch, seen = Scratch(s, "months"), src.observations(s, d)
    table = ob.table(s, f"{scratch.path}/observations")
    kept = features.months(table, f"{scratch.path}/months")
    late, even = F.col("source") == "1-URGENT", F.year("captured_at") % 2 == 0
    for part in (~late & even, ~late & ~even, late):
        table.append(seen.filter(part))
        kept.refresh()
    found = features.from_months(kept.read(), AS_OF)
    return found.select("lake_id", "latest_at", _r("latest_km2").alias("latest_km2"), *[_r(f"growth_{w}").alias(f"growth_{w}") for w in features.WINDOWS], _r("anomaly").alias("anomaly"))


QUERIES = {f.__name__: f for f in (
    water_index, usable_mask_counts, encoded_dn, scene_water_area, scene_candidates_top12, scenes_in_range, latest_usable_scene, observation_dedupe, observation_new_rows, lake_staleness, lake_seed_check,
    obs_lookback, latest_as_of, nearest_within_15d, growth_30_90, seasonal_anomaly, dam_type_risk, normalized_risks, hazard_score_tier, hazard_components, terrain_slope, pixel_metres, exposure_population,
    aoi_bbox_grid, band_align_upsample, bbox_candidates, run_summary, run_latest, run_hazard, score_reports, lake_elevation, scene_processing, backfill_rows,
    latest_from_pixels, run_latest_with_faults, growth_history, mixed_boxes_meet, population_by_place, features_by_month, lake_slopes,
)}

PIXELS = "px AS (SELECT l_orderkey AS scene_id, CAST(l_quantity * 200 AS FLOAT) AS g, CAST(l_extendedprice / 10 AS FLOAT) AS n, l_quantity * 200 AS green, l_extendedprice / 10 AS nir, l_linenumber + 4 AS scl FROM lineitem)"
INDEX = "CASE WHEN g + n <> 0 THEN CAST(CAST(CAST(g - n AS FLOAT) AS DOUBLE) / CAST(CAST(g + n AS FLOAT) AS DOUBLE) AS FLOAT) ELSE CAST(0 AS FLOAT) END"
SCENES = "scenes AS (SELECT user_id AS lake_id, event_id AS scene_id, ts AS acquired_at, event_type AS source, value AS pct, value / 100 AS cf FROM events), ranked AS (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY acquired_at DESC, scene_id DESC) AS rank FROM scenes WHERE pct < 80), cand AS (SELECT * FROM ranked WHERE rank <= 12)"
OBS = "obs AS (SELECT CAST(c_nationkey AS BIGINT) AS lake_id, CAST(o_orderdate AS DATE) AS captured_at, o_orderpriority AS source, max(o_orderkey) AS scene_id, arg_max(o_totalprice, o_orderkey) / 100000 AS area FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), seen AS (SELECT * FROM obs WHERE captured_at >= DATE '2001-06-30' - 548)"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY captured_at DESC, source, scene_id) AS k FROM {t} WHERE captured_at <= DATE '2001-06-30') WHERE k = 1)"


def _near(name: str, days: int) -> str:
    gap = f"abs(date_diff('day', DATE '2001-06-30' - {days}, captured_at))"
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY {gap}, captured_at, source, scene_id) AS k FROM seen WHERE {gap} <= 15) WHERE k = 1)"


LAKES = "lakes AS (SELECT CAST(n_nationkey AS BIGINT) AS lake_id, lower(n_name) AS slug, ['moraine', 'ice', 'unknown', 'bedrock', 'Moraine'][n_regionkey + 1] AS dam_type, n_nationkey % 2 = 0 AS contact, n_nationkey % 3 = 0 AS glof FROM nation)"
GROWTH = ", ".join([OBS, LATEST.format(t="seen"), _near("p30", 30), _near("p90", 90)]) + ", growth AS (SELECT ids.lake_id, l.captured_at AS latest_at, l.area AS area, CASE WHEN a.area <> 0 THEN (l.area - a.area) / a.area END AS g30, CASE WHEN b.area <> 0 THEN (l.area - b.area) / b.area END AS g90 FROM (SELECT DISTINCT lake_id FROM seen) ids LEFT JOIN latest l USING (lake_id) LEFT JOIN p30 a USING (lake_id) LEFT JOIN p90 b USING (lake_id))"
SEASON = "season AS (SELECT l.lake_id, any_value(l.area) AS area, avg(s.area) AS base FROM latest l LEFT JOIN seen s ON s.lake_id = l.lake_id AND month(s.captured_at) = month(l.captured_at) AND year(s.captured_at) <> year(l.captured_at) GROUP BY 1), anomaly AS (SELECT lake_id, CASE WHEN base <> 0 THEN (area - base) / base END AS anomaly FROM season)"
GRID = "grid AS (SELECT vec_id AS lake_id, (i - 1) // 8 AS row, (i - 1) % 8 AS col, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) t(i))"
SLOPE = GRID + """, z AS (SELECT lake_id, row, col, 3000 + 100 * v AS z FROM grid), n AS (SELECT lake_id, z,
  lag(z) OVER x AS zl, lead(z) OVER x AS zr, lag(z) OVER y AS zu, lead(z) OVER y AS zd FROM z WINDOW x AS (PARTITION BY lake_id, row ORDER BY col), y AS (PARTITION BY lake_id, col ORDER BY row)),
g AS (SELECT lake_id, (coalesce(zr, z) - coalesce(zl, z)) / (CASE WHEN zl IS NULL OR zr IS NULL THEN 30.0 ELSE 60.0 END) AS gx, (coalesce(zd, z) - coalesce(zu, z)) / (CASE WHEN zu IS NULL OR zd IS NULL THEN 30.0 ELSE 60.0 END) AS gy FROM n),
slope AS (SELECT lake_id, degrees(avg(atan(sqrt(gx * gx + gy * gy)))) AS deg FROM g GROUP BY 1)"""
ONE_EACH = """risks AS (SELECT l.lake_id, l.slug, l.dam_type, g.g30, s.deg,
  greatest(0.0, least(1.0, 0.5 * coalesce(greatest(g30, 0.0), 0.0) / 0.5 + 0.5 * coalesce(greatest(g90, 0.0), 0.0) / 0.5)) AS area_growth,
  CASE WHEN glof THEN 1.0 ELSE 0.0 END AS historical_glof,
  CASE dam_type WHEN 'moraine' THEN 1.0 WHEN 'ice' THEN 0.8 WHEN 'bedrock' THEN 0.2 ELSE 0.5 END AS dam_type_risk,
  CASE WHEN contact THEN 1.0 ELSE 0.3 END AS glacier_contact,
  CASE WHEN s.deg IS NOT NULL THEN greatest(0.0, least(1.0, s.deg / 40)) END AS slope,
  greatest(0.0, least(1.0, coalesce(greatest(anomaly, 0.0), 0.0) / 0.3)) AS seasonal_anomaly
  FROM lakes l LEFT JOIN growth g USING (lake_id) LEFT JOIN anomaly a USING (lake_id) LEFT JOIN slope s USING (lake_id))"""
RISKS = ", ".join([LAKES, GROWTH, SEASON, SLOPE, ONE_EACH])
CUSTOMER_LAKES = "registry AS (SELECT c_name AS slug, c_custkey AS ordinal FROM customer), seeded AS (SELECT c_name AS slug, CAST(c_custkey AS BIGINT) AS lake_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')), lakes AS (SELECT CAST(c_custkey AS BIGINT) AS lake_id, c_name AS slug, ['moraine', 'ice', 'unknown', 'bedrock', 'Moraine'][c_nationkey % 5 + 1] AS dam_type, c_mktsegment = 'MACHINERY' AS contact, c_acctbal > 5000 AS glof FROM customer WHERE c_acctbal >= 0)"
CUSTOMER_RISKS = ", ".join([CUSTOMER_LAKES, GROWTH.replace("c_nationkey", "c_custkey"), SEASON, SLOPE, ONE_EACH])
TIER = "CASE WHEN score >= 0.65 THEN 'critical' WHEN score >= 0.45 THEN 'high' WHEN score >= 0.25 THEN 'watch' WHEN score IS NOT NULL THEN 'normal' END"


def _fold() -> str:
    """The compensated sum, one pair of columns a term."""
    terms = ["0.30 * area_growth", "0.15 * historical_glof", "0.20 * dam_type_risk", "0.10 * glacier_contact", "0.10 * slope", "0.15 * seasonal_anomaly"]
    steps = ["f0 AS (SELECT *, CAST(0 AS DOUBLE) AS s0, CAST(0 AS DOUBLE) AS c0, " + ", ".join(f"CAST({t.split(' * ')[0]} AS DOUBLE) * CAST({t.split(' * ')[1]} AS DOUBLE) AS x{i}" for i, t in enumerate(terms)) + " FROM risks)"]
    for i in range(len(terms)):
        s, x, t = f"s{i}", f"x{i}", f"(s{i} + x{i})"
        steps.append(f"f{i + 1} AS (SELECT *, {t} AS s{i + 1}, c{i} + CASE WHEN abs({s}) >= abs({x}) THEN ({s} - {t}) + {x} ELSE ({x} - {t}) + {s} END AS c{i + 1} FROM f{i})")
    return ", ".join(steps)


PLACE = "70 + ({k} * 37 % 1000) / 100.0::DOUBLE AS lon, 30 + ({k} * 91 % 1000) / 100.0::DOUBLE AS lat"

ORACLE = {
    "water_index": f"WITH {PIXELS} SELECT scene_id, green, nir, CAST({INDEX} AS DOUBLE) AS ndwi FROM px",
    "usable_mask_counts": f"WITH {PIXELS} SELECT scl AS scene_class, scl NOT IN (3, 8, 9, 10) AS usable, count(*) AS n FROM px GROUP BY 1, 2",
    "encoded_dn": "SELECT CAST(CASE WHEN l_discount <= 1 THEN floor(l_discount * 10000 + 0.5) ELSE floor(l_discount + 0.5) END AS INT) AS dn, CAST(CASE WHEN l_quantity + 0.5 <= 1 THEN floor((l_quantity + 0.5) * 10000 + 0.5) ELSE floor(l_quantity + 1.0) END AS INT) AS dn_large, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "scene_water_area": f"WITH {PIXELS}, m AS (SELECT scene_id, scl NOT IN (3, 8, 9, 10) AS ok, {INDEX} AS i FROM px), a AS (SELECT scene_id, sum(CASE WHEN ok AND i > 0 THEN 1 ELSE 0 END) * 100 / 1e6 AS area, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS DOUBLE) / count(*) AS cf FROM m GROUP BY 1) SELECT scene_id, round(area, 6) AS area_km2, round(cf, 6) AS cloud_fraction, cf <= 0.5 AS accepted FROM a",
    "scene_candidates_top12": f"WITH {SCENES} SELECT lake_id, scene_id, CAST(rank AS INT) AS rank, round(pct, 6) AS cloud_cover_pct FROM cand",
    "scenes_in_range": f"WITH {SCENES} SELECT lake_id, scene_id, CAST(acquired_at AS DATE) AS captured_at FROM ranked WHERE CAST(acquired_at AS DATE) BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'",
    "latest_usable_scene": f"WITH {SCENES} SELECT lake_id, arg_min(scene_id, rank) FILTER (cf <= 0.5) AS scene_id, coalesce(min(rank) FILTER (cf <= 0.5), count(*)) AS scenes_checked FROM cand GROUP BY 1",
    "observation_dedupe": f"WITH {SCENES}, k AS (SELECT *, row_number() OVER (PARTITION BY lake_id, CAST(acquired_at AS DATE), source ORDER BY acquired_at DESC, scene_id DESC) AS w FROM ranked WHERE cf <= 0.5) SELECT lake_id, CAST(CAST(acquired_at AS DATE) AS TIMESTAMP) AS captured_at, source, scene_id FROM k WHERE w = 1",
    "observation_new_rows": f"WITH {OBS} SELECT lake_id, captured_at, source, scene_id, area AS area_km2 FROM obs WHERE scene_id % 2 <> 0",
    "lake_staleness": "SELECT c_custkey AS lake_id, CAST(max(o_orderdate) AS DATE) AS last_captured_at, max(o_orderdate) IS NULL OR TIMESTAMP '2001-08-02' - CAST(CAST(max(o_orderdate) AS DATE) AS TIMESTAMP) > INTERVAL 60 DAY AS stale FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "lake_seed_check": f"WITH {CUSTOMER_LAKES} SELECT slug, ordinal, lake_id, CASE WHEN lake_id IS NULL THEN 'lake not seeded in DB' END AS error FROM registry LEFT JOIN seeded USING (slug)",
    "obs_lookback": f"WITH {OBS} SELECT lake_id, count(*) AS n, min(captured_at) AS first_at, max(captured_at) AS last_at FROM seen GROUP BY 1",
    "latest_as_of": f"WITH {OBS}, {LATEST.format(t='obs')}, ids AS (SELECT DISTINCT lake_id FROM obs) SELECT ids.lake_id, captured_at, scene_id, area AS area_km2 FROM ids LEFT JOIN latest USING (lake_id)",
    "nearest_within_15d": f"WITH {OBS}, {_near('a', 30)}, {_near('b', 90)} SELECT ids.lake_id, a.scene_id AS scene_30, a.captured_at AS at_30, b.scene_id AS scene_90, b.captured_at AS at_90 FROM (SELECT DISTINCT lake_id FROM seen) ids LEFT JOIN a USING (lake_id) LEFT JOIN b USING (lake_id)",
    "growth_30_90": f"WITH {GROWTH} SELECT lake_id, latest_at, round(g30, 6) AS growth_30, round(g90, 6) AS growth_90 FROM growth",
    "seasonal_anomaly": f"WITH {OBS}, {LATEST.format(t='seen')}, {SEASON} SELECT ids.lake_id, round(anomaly, 6) AS anomaly FROM (SELECT DISTINCT lake_id FROM seen) ids LEFT JOIN anomaly USING (lake_id)",
    "dam_type_risk": "SELECT c_custkey AS lake_id, CAST(CASE c_nationkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 3 THEN 0.2 ELSE 0.5 END AS DOUBLE) AS risk, c_nationkey % 5 <> 4 AS recognised FROM customer",
    "normalized_risks": f"WITH {RISKS} SELECT lake_id, round(CAST(area_growth AS DOUBLE), 6) AS area_growth, CAST(historical_glof AS DOUBLE) AS historical_glof, CAST(dam_type_risk AS DOUBLE) AS dam_type, CAST(glacier_contact AS DOUBLE) AS glacier_contact, round(CAST(slope AS DOUBLE), 6) AS slope, round(CAST(seasonal_anomaly AS DOUBLE), 6) AS seasonal_anomaly FROM risks",
    "hazard_score_tier": f"WITH {RISKS}, {_fold()}, done AS (SELECT *, s6 + c6 AS score FROM f6) SELECT lake_id, slug, round(score, 6) AS score, {TIER} AS tier FROM done",
    "hazard_components": f"WITH {RISKS} SELECT lake_id, '1.0' AS version, '2001-06-30' AS as_of, CAST(0.3 AS DOUBLE) AS w_growth, CAST(0.45 AS DOUBLE) AS t_high, round(g30, 6) AS growth_30, dam_type, round(CAST(slope AS DOUBLE), 6) AS slope_risk, true AS no_exposure FROM risks",
    "terrain_slope": f"WITH {SLOPE} SELECT lake_id, round(deg, 6) AS slope_degrees FROM slope",
    "pixel_metres": f"WITH p AS (SELECT c_custkey, {PLACE.format(k='c_custkey')} FROM customer) SELECT c_custkey, round(0.0002::DOUBLE * 111320 * cos(radians(lat)), 6) AS dx_m, round(0.0002::DOUBLE * 111320, 6) AS dy_m FROM p",
    "exposure_population": f"WITH {GRID}, lakes AS (SELECT vec_id AS lake_id, {PLACE.format(k='vec_id')} FROM embeddings), pop AS (SELECT lon + col * 0.002::DOUBLE AS lon, lat + row * 0.002::DOUBLE AS lat, greatest(100 * v, 0) AS pop FROM grid JOIN lakes USING (lake_id)), b AS (SELECT lake_id, lon, lat, 5 * 1000 / 111320::DOUBLE AS dy FROM lakes), f AS (SELECT b.lake_id, sum(pop) AS p FROM b JOIN pop ON pop.lat BETWEEN b.lat - dy AND b.lat + dy AND pop.lon BETWEEN b.lon - dy / cos(radians(b.lat)) AND b.lon + dy / cos(radians(b.lat)) GROUP BY 1) SELECT lake_id, round(coalesce(p, 0), 3) AS population FROM lakes LEFT JOIN f USING (lake_id)",
    "aoi_bbox_grid": f"WITH p AS (SELECT c_custkey, {PLACE.format(k='c_custkey')}, 0.01::DOUBLE AS h FROM customer), b AS (SELECT c_custkey, lon - h AS west, lat - h AS south, lon + h AS east, lat + h AS north FROM p) SELECT c_custkey, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north, greatest(1, CAST(round_even((east - west) * 111320 * cos(radians((south + north) / 2)) / 10, 0) AS INT)) AS width, greatest(1, CAST(round_even((north - south) * 111320 / 10, 0) AS INT)) AS height FROM b",
    "band_align_upsample": f"WITH {GRID}, half AS (SELECT lake_id, row // 2 AS r, col // 2 AS c, avg(v) AS scl FROM grid GROUP BY ALL) SELECT f.lake_id, CAST(f.row AS INT) AS row, CAST(f.col AS INT) AS col, round(f.v, 6) AS v, round(h.scl, 6) AS scl FROM grid f JOIN half h ON h.lake_id = f.lake_id AND h.r = f.row // 2 AND h.c = f.col // 2",
    "bbox_candidates": f"WITH a AS (SELECT CAST(n_nationkey AS BIGINT) AS lake_id, {PLACE.format(k='n_nationkey')} FROM nation), b AS (SELECT c_custkey AS scene_id, {PLACE.format(k='c_custkey')} FROM customer) SELECT lake_id, scene_id FROM a JOIN b ON a.lon - 0.05 <= b.lon + 0.05 AND b.lon - 0.05 <= a.lon + 0.05 AND a.lat - 0.05 <= b.lat + 0.05 AND b.lat - 0.05 <= a.lat + 0.05",
    "run_summary": f"WITH {SCENES} SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT lake_id, CAST(acquired_at AS DATE), source FROM ranked WHERE cf <= 0.5)) AS observations_written, (SELECT CAST(count(*) AS BIGINT) FROM ranked) AS scenes_checked, (SELECT count(DISTINCT lake_id) FROM scenes) AS lakes, false AS failed",
    "run_latest": f"""WITH {SCENES}, there AS (SELECT DISTINCT lake_id, CAST(acquired_at AS DATE) AS d, source FROM ranked WHERE cf <= 0.5 AND CAST(acquired_at AS DATE) <= DATE '{RANGE[1]}'),
best AS (SELECT lake_id, CAST(arg_min(acquired_at, rank) FILTER (cf <= 0.5) AS DATE) AS d, arg_min(source, rank) FILTER (cf <= 0.5) AS source, coalesce(min(rank) FILTER (cf <= 0.5), count(*)) AS n FROM cand GROUP BY 1),
fresh AS (SELECT lake_id, d FROM best ANTI JOIN there USING (lake_id, d, source) WHERE d IS NOT NULL), last AS (SELECT lake_id, max(d) AS d FROM (SELECT lake_id, d FROM there UNION ALL SELECT lake_id, d FROM fresh) GROUP BY 1)
SELECT c_custkey AS ordinal, CAST(c_custkey AS VARCHAR) AS slug, CAST(CASE WHEN f.lake_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS observations_written, coalesce(b.n, 0) AS scenes_checked,
CASE WHEN u.lake_id IS NULL THEN 'lake not seeded in DB' END AS error, l.d IS NULL OR TIMESTAMP '{RUN_AT}' - CAST(l.d AS TIMESTAMP) > INTERVAL 60 DAY AS stale
FROM customer LEFT JOIN (SELECT DISTINCT lake_id FROM scenes) u ON u.lake_id = c_custkey LEFT JOIN best b ON b.lake_id = c_custkey LEFT JOIN fresh f ON f.lake_id = c_custkey LEFT JOIN last l ON l.lake_id = c_custkey""",
    "run_hazard": f"""WITH {CUSTOMER_RISKS}, {_fold()}, place AS (SELECT lake_id, {PLACE.format(k='lake_id')} FROM lakes), spot AS (SELECT lake_id AS id, {PLACE.format(k='lake_id')} FROM (SELECT vec_id AS lake_id FROM embeddings)),
pop AS (SELECT lon + col * 0.002::DOUBLE AS lon, lat + row * 0.002::DOUBLE AS lat, greatest(100 * v, 0) AS pop FROM grid JOIN spot ON id = lake_id), b AS (SELECT lake_id, lon, lat, 5 * 1000 / 111320::DOUBLE AS dy FROM place),
ex AS (SELECT b.lake_id, sum(pop) AS p FROM b JOIN pop ON pop.lat BETWEEN b.lat - dy AND b.lat + dy AND pop.lon BETWEEN b.lon - dy / cos(radians(b.lat)) AND b.lon + dy / cos(radians(b.lat)) GROUP BY 1),
done AS (SELECT g.ordinal, g.slug, s.lake_id, CASE WHEN s.lake_id IS NULL THEN 'lake not seeded in DB' WHEN f.lake_id IS NULL THEN '{hazard.NO_STATIC}' WHEN f.deg IS NULL THEN '{hazard.NO_SLOPE}' END AS error, s6 + c6 AS full_score, deg, p FROM registry g LEFT JOIN seeded s USING (slug) LEFT JOIN f6 f ON f.lake_id = s.lake_id LEFT JOIN ex ON ex.lake_id = s.lake_id),
fin AS (SELECT *, CASE WHEN error IS NULL THEN full_score END AS score FROM done)
SELECT ordinal, slug, lake_id, round(score, 6) AS score, {TIER} AS tier, error IS NULL AS computed, error, CASE WHEN error IS NULL THEN round(deg, 6) END AS slope_deg, CASE WHEN error IS NULL THEN round_even(coalesce(p, 0), 1) END AS people, CASE WHEN error IS NULL THEN 'square' END AS shape, CASE WHEN error IS NULL THEN 'normal' END AS lowest FROM fin""",
    "lake_elevation": f"""WITH {GRID}, t AS (SELECT vec_id AS tile, 70 + (vec_id % 50) * 0.01::DOUBLE AS w, 30 + (vec_id // 50) * 0.01::DOUBLE AS s FROM embeddings), c AS (SELECT tile, w + col * 0.002::DOUBLE AS lon, s + row * 0.002::DOUBLE AS lat, 3000 + 100 * v AS z FROM grid JOIN t ON tile = lake_id),
l AS (SELECT tile AS lake_id, w + 0.006::DOUBLE AS lon, s + 0.006::DOUBLE AS lat, 0.0075::DOUBLE AS h FROM t), i AS (SELECT lake_id, tile, CAST(-round(c.lat / 0.002::DOUBLE) AS INT) AS row, CAST(round(c.lon / 0.002::DOUBLE) AS INT) AS col, z FROM l JOIN c ON c.lon BETWEEN l.lon - h AND l.lon + h AND c.lat BETWEEN l.lat - h AND l.lat + h)
SELECT lake_id, row, col, round(arg_min(z, tile), 6) AS z FROM i GROUP BY 1, 2, 3""",
    "scene_processing": f"WITH {PIXELS}, m AS (SELECT scene_id, scl NOT IN (3, 8, 9, 10) AS ok, {INDEX} AS i FROM px), a AS (SELECT o_orderkey AS scene_id, coalesce(count(*) FILTER (ok AND i > 0), 0) * 100 / 1e6 AS area, CASE WHEN count(m.scene_id) = 0 THEN 1 ELSE CAST(count(*) FILTER (NOT ok) AS DOUBLE) / count(m.scene_id) END AS cf FROM orders LEFT JOIN m ON m.scene_id = o_orderkey GROUP BY 1) SELECT scene_id, round(CAST(area AS DOUBLE), 6) AS area_km2, round(CAST(cf AS DOUBLE), 6) AS cloud_fraction, cf <= 0.5 AS accepted FROM a",
}
ORACLE["score_reports"] = f"""SELECT CAST(lake_id AS VARCHAR) AS "lakeId", 'hazard-1' AS "runId", score, tier, '2001-08-02T00:00:00+00:00' AS "computedAt", '{AS_OF}' AS as_of FROM ({ORACLE['run_hazard']}) WHERE computed"""
ORACLE["lake_slopes"] = f"""WITH {GRID}, t AS (SELECT vec_id AS tile, 70 + (vec_id % 50) * 0.01::DOUBLE AS w, 30 + (vec_id // 50) * 0.01::DOUBLE AS s FROM embeddings), c AS (SELECT tile, w + col * 0.002::DOUBLE AS lon, s + row * 0.002::DOUBLE AS lat, 3000 + 100 * v AS z FROM grid JOIN t ON tile = lake_id),
l AS (SELECT tile AS lake_id, w + 0.006::DOUBLE AS lon, s + 0.006::DOUBLE AS lat, 0.0075::DOUBLE AS h FROM t), i AS (SELECT lake_id, tile, l.lat AS mid, CAST(-round(c.lat / 0.002::DOUBLE) AS INT) AS row, CAST(round(c.lon / 0.002::DOUBLE) AS INT) AS col, z FROM l JOIN c ON c.lon BETWEEN l.lon - h AND l.lon + h AND c.lat BETWEEN l.lat - h AND l.lat + h),
z AS (SELECT lake_id, row, col, arg_min(z, tile) AS z, 0.002::DOUBLE * 111320 AS dy, 0.002::DOUBLE * 111320 * cos(radians(any_value(mid))) AS dx FROM i GROUP BY 1, 2, 3), n AS (SELECT *, lag(z) OVER x AS zl, lead(z) OVER x AS zr, lag(z) OVER y AS zu, lead(z) OVER y AS zd FROM z WINDOW x AS (PARTITION BY lake_id, row ORDER BY col), y AS (PARTITION BY lake_id, col ORDER BY row)),
g AS (SELECT lake_id, (coalesce(zr, z) - coalesce(zl, z)) / (CASE WHEN zl IS NULL OR zr IS NULL THEN 1 ELSE 2 END * dx) AS gx, (coalesce(zd, z) - coalesce(zu, z)) / (CASE WHEN zu IS NULL OR zd IS NULL THEN 1 ELSE 2 END * dy) AS gy FROM n)
SELECT lake_id, round(degrees(avg(atan(sqrt(gx * gx + gy * gy)))), 6) AS slope_degrees FROM g GROUP BY 1"""
ORACLE["features_by_month"] = f"WITH {GROWTH}, {SEASON} SELECT lake_id, latest_at, round(g.area, 6) AS latest_km2, round(g30, 6) AS growth_30, round(g90, 6) AS growth_90, round(anomaly, 6) AS anomaly FROM growth g LEFT JOIN anomaly USING (lake_id)"

ORDER_SCENES = f"""{PIXELS}, m AS (SELECT scene_id, scl NOT IN (3, 8, 9, 10) AS ok, {INDEX} AS i, scene_id % 101 = 0 AND scl = 5 AS broken FROM px), a AS (SELECT scene_id, count(*) FILTER (ok AND i > 0 {{ok}}) * 100 / 1e6 AS area, CAST(count(*) FILTER (NOT ok) AS DOUBLE) / count(*) AS cf, count(*) FILTER (broken) AS n_broken FROM m GROUP BY 1),
scenes AS (SELECT o_custkey AS lake_id, o_orderkey AS scene_id, o_orderdate AS acquired_at, o_orderpriority AS source, o_orderkey % 100 AS pct, coalesce(area, 0) AS area, coalesce(cf, 1) AS cf, coalesce(n_broken, 0) AS n_broken FROM orders LEFT JOIN a ON scene_id = o_orderkey)"""
PLAIN = ORDER_SCENES.format(ok="")
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY lake_id ORDER BY acquired_at DESC, scene_id DESC) AS rank FROM scenes WHERE pct < 80 {more}), cand AS (SELECT * FROM ranked WHERE rank <= 12)"
ORACLE["backfill_rows"] = f"""WITH {CUSTOMER_LAKES}, {PLAIN}, k AS (SELECT *, row_number() OVER (PARTITION BY lake_id, CAST(acquired_at AS DATE), source ORDER BY acquired_at DESC, scene_id DESC) AS w FROM scenes WHERE pct < 80 AND cf <= 0.5 AND lake_id IN (SELECT lake_id FROM seeded))
SELECT lake_id, CAST(acquired_at AS DATE) AS captured_at, source, scene_id, round(CAST(area AS DOUBLE), 6) AS area_km2, round(CAST(cf AS DOUBLE), 6) AS cloud_fraction, true AS has_id, 'backfill' AS run_id FROM k WHERE w = 1"""
ORACLE["latest_from_pixels"] = f"""WITH {PLAIN}, {RANKED.format(more='')} SELECT lake_id, arg_min(scene_id, rank) FILTER (cf <= 0.5) AS scene_id, coalesce(min(rank) FILTER (cf <= 0.5), count(*)) AS scenes_checked,
round(CAST(arg_min(area, rank) FILTER (cf <= 0.5) AS DOUBLE), 6) AS area_km2, round(CAST(arg_min(cf, rank) FILTER (cf <= 0.5) AS DOUBLE), 6) AS cloud_fraction, CAST(NULL AS VARCHAR) AS error FROM cand GROUP BY 1"""
ORACLE["run_latest_with_faults"] = f"""WITH {ORDER_SCENES.format(ok='AND NOT broken')}, {RANKED.format(more='AND scene_id % 211 <> 0 AND scene_id % 307 <> 0')},
lost AS (SELECT lake_id, min(CASE WHEN scene_id % 211 = 0 THEN 'malformed acquired_at: no date' ELSE 'malformed cloud_cover_pct: cloudy' END) AS error FROM scenes WHERE scene_id % 211 = 0 OR scene_id % 307 = 0 GROUP BY 1),
stop AS (SELECT lake_id, coalesce(min(rank) FILTER (cf <= 0.5 OR n_broken > 0), count(*)) AS n, arg_min(n_broken, rank) FILTER (cf <= 0.5 OR n_broken > 0) AS b, CAST(arg_min(acquired_at, rank) FILTER (cf <= 0.5 OR n_broken > 0) AS DATE) AS d FROM cand GROUP BY 1)
SELECT c_custkey AS ordinal, CAST(c_custkey AS VARCHAR) AS slug, CAST(CASE WHEN l.lake_id IS NULL AND b = 0 THEN 1 ELSE 0 END AS BIGINT) AS observations_written, CASE WHEN l.lake_id IS NULL THEN coalesce(n, 0) ELSE 0 END AS scenes_checked,
coalesce(l.error, CASE WHEN b > 0 THEN 'malformed pixels: ' || b END) AS error, l.lake_id IS NOT NULL OR b IS NULL OR b > 0 OR TIMESTAMP '2001-08-02' - CAST(d AS TIMESTAMP) > INTERVAL 60 DAY AS stale
FROM customer LEFT JOIN lost l ON l.lake_id = c_custkey LEFT JOIN stop ON stop.lake_id = c_custkey"""
_SINCE = "o.day BETWEEN q.as_of - 548 AND q.as_of"
_NEAREST = "arg_min(o.area, abs(o.day - (q.as_of - {w})) * 2 + CASE WHEN o.day > q.as_of - {w} THEN 1 ELSE 0 END) FILTER (abs(o.day - (q.as_of - {w})) <= 15)"
ORACLE["growth_history"] = f"""WITH {OBS}, d AS (SELECT lake_id, captured_at AS day, arg_min(area, source) AS area FROM obs GROUP BY 1, 2), q AS (SELECT lake_id, CAST(unnest(generate_series(min(captured_at), max(captured_at), INTERVAL 1 DAY)) AS DATE) AS as_of FROM obs GROUP BY 1),
f AS (SELECT q.lake_id, q.as_of, max(o.day) AS latest_at, arg_max(o.area, o.day) AS area, {_NEAREST.format(w=30)} AS a30, {_NEAREST.format(w=90)} AS a90 FROM q LEFT JOIN d o ON o.lake_id = q.lake_id AND {_SINCE} GROUP BY 1, 2),
m AS (SELECT f.lake_id, f.as_of, avg(o.area) AS base FROM f JOIN obs o ON o.lake_id = f.lake_id AND o.captured_at BETWEEN f.as_of - 548 AND f.as_of AND month(o.captured_at) = month(f.latest_at) AND year(o.captured_at) <> year(f.latest_at) GROUP BY 1, 2)
SELECT lake_id, as_of, latest_at, area AS latest_km2, round(CASE WHEN a30 <> 0 THEN (area - a30) / a30 END, 6) AS growth_30, round(CASE WHEN a90 <> 0 THEN (area - a90) / a90 END, 6) AS growth_90, round(CASE WHEN base <> 0 THEN (area - base) / base END, 6) AS anomaly FROM f LEFT JOIN m USING (lake_id, as_of)"""
_MIXED = "c AS (SELECT c_custkey AS lake_id, {place}, 0.002::DOUBLE * pow(10::DOUBLE, CASE WHEN c_custkey % 100 = 0 THEN 3 ELSE c_custkey % 3 END) AS h FROM customer)".format(place=PLACE.format(k="c_custkey"))
ORACLE["mixed_boxes_meet"] = f"""WITH {_MIXED}, s AS (SELECT s_suppkey AS scene_id, {PLACE.format(k='s_suppkey')} FROM supplier)
SELECT lake_id, scene_id FROM c JOIN s ON c.lon - h <= s.lon + 0.03::DOUBLE AND s.lon - 0.03::DOUBLE <= c.lon + h AND c.lat - h <= s.lat + 0.03::DOUBLE AND s.lat - 0.03::DOUBLE <= c.lat + h"""
ORACLE["population_by_place"] = f"""WITH {GRID}, {_MIXED}, p AS (SELECT vec_id AS id, {PLACE.format(k='vec_id')} FROM embeddings), pop AS (SELECT lon + col * 0.002::DOUBLE AS x, lat + row * 0.002::DOUBLE AS y, greatest(100 * v, 0) AS pop FROM grid JOIN p ON id = lake_id)
SELECT lake_id, count(*) AS n_cells, round(sum(pop), 3) AS population FROM c JOIN pop ON x BETWEEN lon - h AND lon + h AND y BETWEEN lat - h AND lat + h GROUP BY 1"""
