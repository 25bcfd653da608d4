"""Table-driven cases of the lake operators, and each registered query against its SQL.

Tier borders, weights and the results of the worked cases are fixed values of the methodology.
"""

import datetime as dt
import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from moraine.functions import pixels as px, risk
from moraine.operators import asof, features, hazard, observations as ob, scenes as sc, terrain
from moraine.plans import queries, runs
from moraine.sources import providers
from moraine.sources.keyed import KeyedTable
from moraine.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"
D = dt.date.fromisoformat
OBS = "lake_id long, captured_at date, source string, scene_id long, area_km2 double"


def obs(spark, *rows):
    return spark.createDataFrame([(1, D(d), "s", k, a) for k, (d, a) in enumerate(rows)], OBS)


def one(df):
    return df.first()


@pytest.mark.parametrize(("g", "n", "want"), [(100, 20, 80 / 120), (80, 150, -70 / 230), (0, 0, 0.0), (1, -1, 0.0)])
def test_water_index(spark, g, n, want):
    got = one(spark.sql(f"SELECT {g} AS g, {n} AS n").select(px.water_index(F.col("g"), F.col("n"))))[0]
    assert got == pytest.approx(want, abs=1e-6)


def test_masks_and_area(spark):
    df = spark.createDataFrame([(c,) for c in (3, 4, 6, 8, 9, 10, 11, 0)], "c int")
    assert [r[0] for r in df.select(px.usable(F.col("c"))).collect()] == [False, True, True, False, False, False, True, True]
    t = spark.createDataFrame([(True, True), (True, True), (True, False), (False, True)], "w boolean, m boolean")
    r = one(t.agg(px.water_area_km2(F.col("w")), px.water_area_km2(F.col("w") & F.col("m")), px.cloud_fraction(F.col("m"))))
    assert tuple(r) == (0.0003, 0.0002, 0.25)
    r = one(t.filter("false").agg(px.water_area_km2(F.col("w")), px.cloud_fraction(F.col("m"))))
    assert tuple(r) == (0.0, 1.0)


def test_cloud_limit_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.51,)], "c double")
    assert [r[0] for r in df.select(sc.is_usable(F.col("c"))).collect()] == [True, False]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("2026-06-01", 1.0), ("2026-07-01", 1.5)], 0.5),
        ([("2026-07-01", 1.5)], None),
        ([("2026-08-01", 1.5)], None),
        ([("2026-05-17", 1.0), ("2026-07-01", 2.0)], 1.0),  # 15 days from the target
        ([("2026-05-16", 1.0), ("2026-07-01", 2.0)], None),  # 16 days
        ([("2026-05-29", 1.0), ("2026-06-04", 2.0), ("2026-07-01", 3.0)], 2.0),  # equidistant: the earlier
        ([("2026-06-01", 0.0), ("2026-07-01", 3.0)], None),
        ([("2026-06-10", 2.0)], 0.0),  # nearest is the latest itself
    ],
)
def test_growth(spark, rows, want):
    got = one(features.growth(obs(spark, *rows), "2026-07-01"))["growth_30"]
    assert got == (None if want is None else pytest.approx(want))


def test_anomaly_and_lookahead(spark):
    rows = [("2024-07-01", 1.0), ("2025-07-01", 1.0), ("2026-07-01", 1.4)]
    assert one(features.seasonal_anomaly(obs(spark, *rows), "2026-07-01"))["anomaly"] == pytest.approx(0.4)
    # a past as_of sees later years, unless strict
    assert one(features.seasonal_anomaly(obs(spark, *rows), "2025-07-02"))["anomaly"] == pytest.approx(1.0 / 1.2 - 1)
    assert ob.lookback(obs(spark, *rows), "2025-07-02").count() == 3
    assert ob.lookback(obs(spark, *rows), "2025-07-02", strict=True).count() == 2


def test_features_together_are_those_apart(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(12), D("2024-01-01") + dt.timedelta(days=rng.randrange(950)), rng.choice("ab"), k, rng.choice([0.0, rng.random()])) for k in range(400)]
    seen = spark.createDataFrame([*rows, (20, D("2027-01-01"), "a", 1, 1.0), (21, D("2026-07-01"), "a", 2, None)], OBS)
    apart = features.growth(seen, "2026-07-01").join(features.seasonal_anomaly(seen, "2026-07-01"), "lake_id")
    norm = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    both = features.together(seen, "2026-07-01")
    assert norm(both.select(apart.columns)) == norm(apart) and len(norm(both)) == 14


def test_months_give_the_features_of_the_series(spark, tmp_path):
    """Folded after any batches, late rows, replays and compactions: the features of the observations themselves."""
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 2, 3, None]), D("2024-01-01") + dt.timedelta(days=rng.randrange(1100)), rng.choice("ab"), k, rng.choice([0.0, None, rng.random()])) for k in range(500)]
    rows += [(7, D("2020-01-01"), "a", 900, 1.0), (8, D("2027-01-01"), "a", 901, 1.0), (9, None, "a", 902, 1.0)]
    rng.shuffle(rows)
    table = ob.table(spark, str(tmp_path / "obs"))
    months = features.months(table, str(tmp_path / "months"))
    assert features.from_months(months.read(), "2026-07-01").count() == 0
    norm = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    months.parts = 3
    for k, cut in enumerate(range(0, len(rows), 90)):
        table.append(spark.createDataFrame(rows[cut : cut + 90], OBS))
        if k in (2, 4):
            table.compact()
        if k != 1:  # two appends at once
            assert months.refresh() == months.refresh()
        if k == 4:
            table.vacuum()
    assert months.table.version().number == table.version().number and len(months.table.version().folders) <= 4
    got = months.read()
    assert got.groupBy("lake_id", "month").count().filter("count > 1").count() == 0 and got.selectExpr("max(size(days))").first()[0] <= 31
    for as_of in ("2026-07-01", "2025-02-28", "2027-03-01", "2019-01-01"):
        for strict in (False, True):
            want = features.together(ob.lookback(table.read(), as_of, strict), as_of)
            assert norm(features.from_months(got, as_of, strict).select(want.columns)) == norm(want), (as_of, strict)
    plan = features.from_months(got, "2026-07-01", True)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(month," in plan and "LessThanOrEqual(month," in plan  # older months are not read


def test_months_read_new_rows_only(spark, tmp_path, monkeypatch):
    table = ob.table(spark, str(tmp_path / "obs"))
    read = []
    months = features.months(table, str(tmp_path / "months"))
    fold = months.fold
    months.fold = lambda df: read.append(df.count()) or fold(df)
    batch = lambda *ids: spark.createDataFrame([(1, D("2026-01-01") + dt.timedelta(days=k), "s", k, 1.0) for k in ids], OBS)
    for ids in ((1, 2, 3), (3, 4), (1,), (9,)):
        table.append(batch(*ids))
        months.refresh()
    assert read == [3, 1, 1]
    # a refresh that another one overtakes leaves its part behind nowhere
    table.append(batch(20))
    other, claim, done = features.months(table, str(tmp_path / "months")), KeyedTable._claim, []

    def late(self, number, folders):
        if self is months.table and not done:
            done.append(other.refresh())
        return claim(self, number, folders)

    monkeypatch.setattr(KeyedTable, "_claim", late)
    assert months.refresh() == done[0] and months.table.vacuum() == 0
    assert months.read().selectExpr("sum(size(days))").first()[0] == 6
    # rows that were compacted and removed before they were folded: all is folded again
    for k in (30, 31):
        table.append(batch(k))
    table.compact()
    table.vacuum()
    months.refresh()
    assert read[-1] == 8 and months.read().selectExpr("sum(size(days))").first()[0] == 8


def scored(spark, **over):
    base = dict(lake_id=1, dam_type="bedrock", glacier_contact=False, historical_glof=False, growth_30=None, growth_90=None, anomaly=None, slope_degrees=0.0)
    schema = "lake_id long, dam_type string, glacier_contact boolean, historical_glof boolean, growth_30 double, growth_90 double, anomaly double, slope_degrees double"
    row = base | over
    return one(hazard.components(hazard.risks(spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)), "2026-07-01"))


def test_scores(spark):
    assert scored(spark)["score"] == pytest.approx(0.07) and scored(spark)["tier"] == "normal"
    r = scored(spark, dam_type="moraine", glacier_contact=True, historical_glof=True)
    assert (r["score"], r["tier"]) == (0.45, "high")  # plain addition gives 0.44999999999999996
    assert scored(spark, growth_90=1.0)["risk_area_growth"] == 1.0  # clamped as a sum
    r = scored(spark, dam_type="Moraine", glacier_contact=None, historical_glof=None)
    assert (r["risk_dam_type"], r["risk_glacier_contact"], r["risk_historical_glof"]) == (0.5, 0.3, 0.0)
    assert '"growth_30d_pct":null' in r["components"]


def test_tiers_and_fold(spark):
    edges = [(0.0, "normal"), (0.24, "normal"), (0.25, "watch"), (0.44, "watch"), (0.45, "high"), (0.64, "high"), (0.65, "critical"), (1.0, "critical")]
    df = spark.createDataFrame(edges, "v double, t string")
    assert df.filter(risk.tier(F.col("v")) != F.col("t")).count() == 0
    rng = random.Random(3)
    rows = [tuple(rng.choice([0.0, 0.2, 0.3, 0.5, 0.8, 1.0, rng.random()]) for _ in risk.WEIGHTS) for _ in range(400)]
    got = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in risk.WEIGHTS)).withColumn("s", risk.score({k: F.col(k) for k in risk.WEIGHTS})).collect()
    assert all(r["s"] == sum(w * r[k] for k, w in risk.WEIGHTS.items()) for r in got)  # Python's sum is compensated


@pytest.mark.parametrize(("rise", "want"), [(0.0, 0.0), (30.0, 45.0), (15.0, math.degrees(math.atan(0.5)))])
def test_slope(spark, rise, want):
    cells = spark.createDataFrame([(1, r, c, c * rise, 30.0, 30.0) for r in range(10) for c in range(10)], "lake_id long, row int, col int, z double, dx_m double, dy_m double")
    assert one(terrain.mean_slope(cells))["slope_degrees"] == pytest.approx(want)


def brute_slope(z, dx, dy):
    """Of cells {(row, col): z}: differences to the neighbours that are there."""
    steep = []
    for (r, c), v in z.items():
        if v is None:
            continue
        def change(before, after, spacing):
            steps = 2 if before is not None and after is not None else 1
            return ((v if after is None else after) - (v if before is None else before)) / (steps * spacing)
        steep.append(math.atan(math.hypot(change(z.get((r, c - 1)), z.get((r, c + 1)), dx), change(z.get((r - 1, c)), z.get((r + 1, c)), dy))))
    return math.degrees(sum(steep) / len(steep)) if steep else None


def test_slope_of_tiles_is_that_of_cells(spark):
    rng = random.Random(12)
    shapes = {1: (7, 9), 2: (1, 1), 3: (1, 12), 4: (12, 1), 5: (3, 3), 6: (4, 4)}
    whole = {k: {(r - 5, c - 4): rng.uniform(3000, 3100) for r in range(h) for c in range(w)} for k, (h, w) in shapes.items()}
    schema = "lake_id long, row int, col int, z double, dx_m double, dy_m double"
    table = lambda grids: spark.createDataFrame([(k, r, c, z, 30.0, 20.0 + k) for k, g in grids.items() for (r, c), z in g.items()], schema)
    want = dict(terrain.mean_slope(table(whole)).collect())
    # holes, null cells, a row and a column that are missing, a lake of nulls only
    holes = {k: {at: (None if rng.random() < 0.1 else z) for at, z in g.items() if rng.random() < 0.8 and at[0] != -3} for k, g in whole.items() if k in (1, 5, 6)} | {7: {(0, 0): None}}
    for side in (1, 2, 3, 4, 64):
        got = dict(terrain.mean_slope_tiled(table(whole), side).collect())
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}, side
        got = dict(terrain.mean_slope_tiled(table(holes), side).collect())
        assert got == {k: pytest.approx(v, abs=1e-9) if v is not None else None for k, v in ((k, brute_slope(g, 30.0, 20.0 + k)) for k, g in holes.items())}, side
    assert terrain.mean_slope_tiled(table({}).limit(0)).count() == 0


def test_tiles_save_two_exchanges(spark):
    cells = spark.range(4000).selectExpr("id % 3 AS lake_id", "CAST(id % 2 AS int) AS tile", "CAST(id / 60 AS int) AS row", "CAST(id % 60 AS int) AS col", "CAST(id AS double) AS z", "30D AS dx_m", "30D AS dy_m")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    merged = cells.groupBy("lake_id", "row", "col").agg(F.min(F.struct("tile", "z", "dx_m", "dy_m")).alias("t")).select("lake_id", "row", "col", "t.z", "t.dx_m", "t.dy_m")
    assert (exchanges(terrain.mean_slope(merged)), exchanges(terrain.mean_slope_tiled(cells))) == (4, 2)


def test_population(spark):
    lakes = spark.createDataFrame([(1, 74.6, 36.4), (2, 10.0, 10.0)], "lake_id long, lon double, lat double")
    pop = spark.createDataFrame([(74.6 + i / 1000, 36.4, 2.0) for i in range(5)] + [(74.6, 36.401, -99999.0), (75.6, 36.4, 7.0)], "lon double, lat double, pop double")
    small, large = (dict(terrain.exposure(lakes, pop, r).collect()) for r in (0.2, 5.0))
    assert large == {1: 10.0, 2: 0.0} and 0 < small[1] < large[1]


def test_population_of_shared_places(spark, monkeypatch):
    seen, join = [], terrain.points_in_boxes
    monkeypatch.setattr(terrain, "points_in_boxes", lambda boxes, points: seen.append((boxes.count(), points.count())) or join(boxes, points))
    lakes = spark.createDataFrame([(i, 74.6 + i % 2, 36.4) for i in range(20)], "lake_id long, lon double, lat double")
    pop = spark.createDataFrame([(74.6, 36.4 + i % 3 / 1000, 2.0 - 3 * (i == 0)) for i in range(30)], "lon double, lat double, pop double")
    assert dict(terrain.exposure(lakes, pop, 5.0).collect()) == {i: 0.0 if i % 2 else 58.0 for i in range(20)}
    assert seen == [(2, 3)]


def test_alignment(spark):
    fine = spark.range(223 * 180).selectExpr("1L AS lake_id", "cast(id div 180 AS int) AS row", "cast(id % 180 AS int) AS col")
    coarse = spark.range(111 * 90).selectExpr("1L AS lake_id", "cast(id div 90 AS int) AS row", "cast(id % 90 AS int) AS col", "id AS scl")
    got = terrain.align(fine, coarse, ["lake_id"])
    assert got.count() == 222 * 180
    assert got.join(terrain.upsample(coarse), ["lake_id", "row", "col", "scl"]).count() == 222 * 180


def scenes(spark, *rows):
    return spark.createDataFrame([(1, i, dt.datetime.fromisoformat(t), "s", p, c) for i, (t, p, c) in enumerate(rows)], "lake_id long, scene_id long, acquired_at timestamp_ntz, source string, cloud_cover_pct double, cloud_fraction double")


def test_scene_choice(spark):
    df = scenes(spark, ("2026-07-20T09:00", 5.0, 0.9), ("2026-07-20T05:00", 5.0, 0.1), ("2026-07-10T05:00", 5.0, 0.1), ("2026-07-21T00:00", 80.0, 0.0), ("2026-07-22T00:00", None, 0.0))
    r = one(sc.latest_usable(df))
    assert (r["scene_id"], r["scenes_checked"]) == (1, 2)
    # the cloudy newer scene of a day does not hide the clear older one
    assert {x["scene_id"] for x in sc.first_of_day(sc.searched(df)).collect()} == {1, 2}
    assert one(sc.latest_usable(df.filter("cloud_fraction > 0.5")))["scene_id"] is None


def test_staleness(spark):
    lakes = spark.createDataFrame([(1,), (2,), (3,)], "lake_id long")
    seen = spark.createDataFrame([(1, D("2026-05-02")), (2, D("2026-05-02"))], "lake_id long, captured_at date")
    at = lambda now: {r["lake_id"]: r["stale"] for r in ob.status(lakes, seen, now).collect()}
    assert at("2026-07-01 00:00:00") == {1: False, 2: False, 3: True}
    assert at("2026-07-01 00:00:01") == {1: True, 2: True, 3: True}


def test_seeding_broadcasts_by_size_only(spark):
    registry = spark.range(50).selectExpr("concat('l', id) AS slug", "id AS ordinal")
    found = ob.seeded(registry, registry.filter("ordinal < 20").selectExpr("slug", "ordinal AS lake_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r["ordinal"]: (r["lake_id"], r["error"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: (i, None) if i < 20 else (None, "lake not seeded in DB") for i in range(50)}


def test_backfill_and_append_and_stream(spark, tmp_path):
    df = scenes(spark, ("2026-01-05T00:00", 5.0, 0.1), ("2026-02-05T00:00", 5.0, 0.1), ("2026-02-05T10:00", 5.0, 0.2), ("2026-03-05T00:00", 5.0, 0.9))
    registry = spark.createDataFrame([("a", 0), ("b", 1)], "slug string, ordinal int")
    lakes = spark.createDataFrame([("a", 1)], "slug string, lake_id long")
    none = spark.createDataFrame([], "lake_id long, captured_at date, source string")
    new, results = runs.run_backfill(registry, lakes, df, none, "2026-01-05", "2026-03-05")
    assert {r["scene_id"] for r in new.collect()} == {0, 2}
    assert tuple(one(runs.summary(results))) == (2, 4, 2, True)
    table = str(tmp_path / "obs")
    for _ in range(2):
        ob.append(new, table)
    assert ob.table(spark, table).read().count() == 2
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["scene_id"] for r in ob.table(spark, str(tmp_path / "out")).read().collect()} == {0, 2}


STATIC = "lake_id long, dam_type string, glacier_contact boolean, historical_glof boolean"


def hazard_tables(spark):
    """Lakes a to e: scored, without observations, not seeded, without a static row, without elevation."""
    registry = spark.createDataFrame([(x, k) for k, x in enumerate("abcde")], "slug string, ordinal int")
    lakes = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4), ("e", 5)], "slug string, lake_id long")
    static = spark.createDataFrame([(1, "moraine", True, True), (2, None, None, None), (5, "ice", False, False)], STATIC)
    rows = [(1, D(d), "s", k, v) for k, (d, v) in enumerate([("2026-04-02", 1.0), ("2026-06-01", 1.0), ("2026-07-01", 2.0)])]
    slope = spark.createDataFrame([(1, 40.0), (2, 0.0), (4, 10.0)], "lake_id long, slope_degrees double")
    people = spark.createDataFrame([(1, 12.25), (2, 0.0)], "lake_id long, population double")
    return registry, lakes, static, spark.createDataFrame(rows, OBS), slope, people


def test_hazard_pass_has_a_row_for_every_lake(spark):
    registry, lakes, static, seen, slope, people = hazard_tables(spark)
    got = {r["slug"]: r for r in runs.run_hazard(registry, lakes, static, seen, slope, "2026-07-01", people, "2026-07-02 00:00:00").collect()}
    assert {k: r["error"] for k, r in got.items()} == {"a": None, "b": None, "c": "lake not seeded in DB", "d": hazard.NO_STATIC, "e": hazard.NO_SLOPE}
    for r in got.values():
        assert (r["error"] is None) == (r["score"] is not None) == (r["tier"] is not None) == (r["components"] is not None) == (r["computed_at"] is not None)
    # growth, dam, contact, slope and history at their most, no other year to compare with
    assert got["a"]["score"] == pytest.approx(0.85) and got["a"]["tier"] == "critical"
    # a static row with nulls is scored: unknown dam, no contact, no history
    assert got["b"]["score"] == pytest.approx(0.2 * 0.5 + 0.1 * 0.3) and got["b"]["tier"] == "normal"


def test_hazard_document(spark):
    registry, lakes, static, seen, slope, people = hazard_tables(spark)
    got = {r["slug"]: r for r in runs.run_hazard(registry, lakes, static, seen, slope, "2026-07-01", people).collect()}
    document = json.loads(got["a"]["components"])
    assert list(document) == ["methodology_version", "as_of", "weights", "tier_thresholds", "raw_inputs", "normalized_risks", "exposure"]
    assert document["tier_thresholds"] == [[0.65, "critical"], [0.45, "high"], [0.25, "watch"], [0.0, "normal"]]
    assert document["raw_inputs"] == {"growth_30d_pct": 1.0, "growth_90d_pct": 1.0, "seasonal_anomaly_pct": None, "dam_type": "moraine", "glacier_contact": True, "slope_deg": 40.0, "historical_glof": True}
    assert {k: document["exposure"][k] for k in ("source", "buffer_km", "buffer_shape", "population_within_buffer")} == {"source": terrain.POPULATION_SOURCE, "buffer_km": 5.0, "buffer_shape": "square", "population_within_buffer": 12.2}
    # the document alone gives the score
    assert sum(w * document["normalized_risks"][k] for k, w in document["weights"].items()) == got["a"]["score"]
    # exposure has no weight
    without = {r["slug"]: r for r in runs.run_hazard(registry, lakes, static, seen, slope, "2026-07-01").collect()}
    assert without["a"]["score"] == got["a"]["score"] and json.loads(without["a"]["components"])["exposure"] is None


def test_reports_of_scored_lakes(spark):
    registry, lakes, static, seen, slope, people = hazard_tables(spark)
    done = runs.run_hazard(registry, lakes, static, seen, slope, "2026-07-20", people, "2026-07-20 00:00:00")
    got = {r["lakeId"]: r for r in runs.score_reports(done, "hazard-7").collect()}
    assert set(got) == {"1", "2"} and all(r["runId"] == "hazard-7" and r["computedAt"] == "2026-07-20T00:00:00+00:00" for r in got.values())
    assert list(got["1"].asDict()) == ["lakeId", "runId", "score", "tier", "components", "computedAt"]


def test_lake_without_slope_has_no_score(spark):
    r = scored(spark, slope_degrees=None)
    assert (r["risk_slope"], r["score"], r["tier"], r["components"]) == (None, None, None, None)


def test_latest_run(spark):
    df = scenes(spark, ("2026-07-20T09:00", 5.0, 0.9), ("2026-07-20T05:00", 5.0, 0.1), ("2026-07-10T05:00", 5.0, 0.1))
    df = df.unionAll(df.limit(1).withColumn("lake_id", F.lit(2).cast("long")).withColumn("cloud_fraction", F.lit(0.9)))
    registry = spark.createDataFrame([(x, k) for k, x in enumerate("abcd")], "slug string, ordinal int")
    lakes = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "slug string, lake_id long")
    none = spark.createDataFrame([], "lake_id long, captured_at date, source string")
    new, results = runs.run_latest(registry, lakes, df, none, "2026-07-21 00:00:00")
    got = {r["slug"]: (r["observations_written"], r["scenes_checked"], r["stale"], r["error"]) for r in results.collect()}
    assert got == {"a": (1, 2, False, None), "b": (0, 1, True, None), "c": (0, 0, True, "lake not seeded in DB"), "d": (0, 0, True, None)}
    # what was written before is not written or counted again
    assert {r["slug"]: r["observations_written"] for r in runs.run_latest(registry, lakes, df, new, "2026-07-21 00:00:00")[1].collect()} == dict.fromkeys("abcd", 0)
    ids = ob.identified(new.unionAll(new), runs.run_id("latest")).collect()
    assert len({r["row_id"] for r in ids}) == 2 and len({r["run_id"] for r in ids}) == 1


def test_single_lake_run(spark):
    df = scenes(spark, ("2026-07-20T09:00", 5.0, 0.1))
    df = df.unionAll(df.withColumn("lake_id", F.lit(2).cast("long")).withColumn("cloud_fraction", F.lit(0.9)))
    registry = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "slug string, lake_id long")
    got = {x: tuple(one(runs.run_one(registry, df, x).select("exit_code", "scene_id", "scenes_checked", "message"))) for x in "abcz"}
    assert got == {"a": (0, 0, 1, None), "b": (1, None, 1, "STALE: no usable scene"), "c": (1, None, 0, "no scenes"), "z": (2, None, 0, "unknown lake")}
    lines = {x: one(runs.report_lines(runs.run_one(registry, df, x)))["line"] for x in "az"}
    assert lines == {"a": "lake: a, scene: 0, captured: 2026-07-20, scenes checked: 1", "z": "z: unknown lake"}


def test_daily_job(spark, tmp_path):
    registry, lakes, static, _, slope, _ = hazard_tables(spark)
    df = scenes(spark, ("2026-06-01T05:00", 5.0, 0.1), ("2026-07-01T05:00", 5.0, 0.9)).withColumn("area_km2", F.lit(1.0))
    run = lambda now, df=df: runs.run_daily(registry, lakes, static, df, ob.table(spark, str(tmp_path / "obs")), slope, now[:10], now)
    results, scored = run("2026-06-02 00:00:00")
    assert [(r["observations_written"], r["stale"]) for r in results.orderBy("ordinal").collect()] == [(1, False), (0, True), (0, True), (0, True), (0, True)]
    assert {r["slug"]: r["score"] is not None for r in scored.collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}
    assert [r["observations_written"] for r in run("2026-06-02 00:00:00")[0].collect()] == [0] * 5
    grown = scenes(spark, ("2026-07-01T05:00", 5.0, 0.1)).withColumn("area_km2", F.lit(2.0))
    scored = {r["slug"]: r for r in run("2026-07-01 00:00:00", grown)[1].collect()}
    assert json.loads(scored["a"]["components"])["raw_inputs"]["growth_30d_pct"] == 1.0
    assert ob.table(spark, str(tmp_path / "obs")).read().count() == 2


def test_search_of_some_lakes(spark):
    df = scenes(spark, ("2026-07-20T09:00", 5.0, 0.1))
    df = df.unionAll(df.withColumn("lake_id", F.lit(2).cast("long")))
    assert [sc.searched(df, x).count() for x in (None, [], [2], [1, 2], [3])] == [2, 2, 1, 2, 0]


def test_scene_without_pixels_is_all_cloud(spark):
    pixels = spark.createDataFrame([(1, 100, 20, 6), (1, 100, 20, 9)], "scene_id long, green int, nir int, scene_class int")
    got = {r["scene_id"]: (r["area_km2"], r["cloud_fraction"]) for r in sc.processed(spark.range(1, 3).withColumnRenamed("id", "scene_id"), pixels).collect()}
    assert got == {1: (0.0001, 0.5), 2: (0.0, 1.0)}


def test_elevation_of_overlapping_tiles(spark):
    box = lambda w, s, e, n: (w, s, e, n)
    kind = "box struct<west:double,south:double,east:double,north:double>"
    tiles = spark.createDataFrame([(1, box(0.0, 0.0, 0.3, 0.3)), (2, box(0.2, 0.0, 0.5, 0.3)), (3, box(5.0, 5.0, 5.3, 5.3))], f"tile int, {kind}")
    cells = [(t, w + c / 10, r / 10, 100.0 * t + c) for t, w in ((1, 0.0), (2, 0.2)) for r in range(4) for c in range(4)]
    lakes = spark.createDataFrame([(7, box(0.05, 0.05, 0.45, 0.15)), (8, box(2.0, 2.0, 2.1, 2.1))], f"lake_id long, {kind}")
    got = terrain.lake_elevation(lakes, tiles, spark.createDataFrame(cells, "tile int, lon double, lat double, z double"), 0.1)
    assert {(r["lake_id"], r["row"], r["col"]): r["z"] for r in got.collect()} == {(7, -1, 1): 101.0, (7, -1, 2): 102.0, (7, -1, 3): 103.0, (7, -1, 4): 202.0}
    assert {tuple(r) for r in terrain.tiles_of(lakes, tiles).collect()} == {(7, 1), (7, 2)}  # lake 8 gets the error row


def test_a_later_lake_costs_its_own_tiles(spark, tmp_path):
    box = lambda x: (x, 0.0, x + 1.0, 1.0)
    lakes = lambda *ids: spark.createDataFrame([(i, box(float(i))) for i in ids], "lake_id long, box struct<west:double,south:double,east:double,north:double>")
    memo, made = terrain.slope_memo(spark, str(tmp_path / "slope")), []

    def make(missing):
        made.append(sorted(r["lake_id"] for r in missing.collect()))
        return missing.select("lake_id", F.when(F.col("lake_id") != 9, F.col("lake_id") * 2.5).alias("slope_degrees"))

    found = lambda df: dict(terrain.remembered(df, memo, make).collect())
    assert found(lakes(1, 2)) == found(lakes(1, 2)) == {1: 2.5, 2: 5.0}
    assert found(lakes(1, 2, 3)) == {1: 2.5, 2: 5.0, 3: 7.5}
    # a box without tiles is asked for again; another lake with a known box is not
    assert found(lakes(9, 1)) == found(lakes(9, 1)) == {1: 2.5, 9: None}
    twin = lakes(2).withColumn("lake_id", F.lit(22).cast("long"))
    assert found(twin) == {22: 5.0}
    assert made == [[1, 2], [3], [9], [9]]


def test_source_choice(spark):
    made = []
    table = lambda name: lambda: made.append(name) or providers.Tables(spark.range(1).withColumnRenamed("id", "scene_id"), spark.range(0), name)
    known = {"open": table("open"), "live": table("live")}
    assert one(providers.choose(spark, known, "live").scenes())["source"] == "live"
    spark.conf.set(providers.SETTING, "open")
    try:
        assert one(providers.choose(spark, known, "live").scenes())["source"] == "open"
        assert one(providers.choose(spark, known, "open", "live").scenes())["source"] == "live"
    finally:
        spark.conf.unset(providers.SETTING)
    assert made == ["live", "open", "live"]
    with pytest.raises(ValueError, match="known: live, open"):
        providers.choose(spark, known, "other")


def random_boxes(rng, n, name):
    """(key, box): from a few metres to a country, some points, some at the edges of cells."""
    out = []
    for k in range(n):
        w, h = (rng.choice([0.0, 0.0001, 0.01, 0.3, 5.0, 40.0]) for _ in range(2))
        x, y = (rng.choice([rng.uniform(60, 90), 67.5, 70.3125]) for _ in range(2))
        out.append((k, (x, y, x + w, y + h)))
    return out, f"{name} long, {'box' if name == 'a' else 'other'} struct<west:double,south:double,east:double,north:double>"


def test_boxes_of_any_size_meet_once(spark):
    rng = random.Random(5)
    (a, sa), (b, sb) = random_boxes(rng, 150, "a"), random_boxes(rng, 150, "b")
    got = sorted(map(tuple, terrain.boxes_meet(spark.createDataFrame(a, sa), spark.createDataFrame(b, sb)).select("a", "b").collect()))
    assert got == sorted((i, k) for i, p in a for k, q in b if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    # rows a box are bounded, whatever its size
    rows = terrain.cover(spark.createDataFrame(a, sa).withColumn("level", terrain.level_of(F.col("box")))).groupBy("a").count()
    assert rows.agg(F.max("count")).first()[0] <= 4
    points = [(k, rng.choice([rng.uniform(60, 90), 67.5]), rng.uniform(60, 90)) for k in range(400)]
    met = terrain.points_in_boxes(spark.createDataFrame(a, sa), spark.createDataFrame(points, "p long, lon double, lat double"))
    assert sorted(map(tuple, met.select("a", "p").collect())) == sorted((i, k) for i, q in a for k, x, y in points if q[0] <= x <= q[2] and q[1] <= y <= q[3])


def test_crowded_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(terrain, "PIECE", 400, raising=False)
    monkeypatch.setattr(terrain, "TASK", 2000, raising=False)
    rng = random.Random(7)
    (a, sa), (b, sb) = random_boxes(rng, 150, "a"), random_boxes(rng, 150, "b")
    # villages of one cell, all of which meet, and copies of a box
    a += [(1000 + k, (75.0, 35.0, 75.3, 35.3) if k % 2 else (75.0 + k / 1e4, 35.0, 75.3, 35.3)) for k in range(150)]
    b += [(1000 + k, (75.1, 35.1, 75.4, 35.4 + k / 1e4)) for k in range(150)]
    met = terrain.boxes_meet(spark.createDataFrame(a, sa), spark.createDataFrame(b, sb)).select("a", "b")
    want = sorted((i, k) for i, p in a for k, q in b if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    assert sorted(map(tuple, met.collect())) == want and len(want) > 150 * 150
    per_task = met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 6000
    points = [(k, 75.2 + k / 1e5, 35.2) for k in range(300)] + [(1000 + k, rng.uniform(60, 90), rng.uniform(60, 90)) for k in range(100)]
    met = terrain.points_in_boxes(spark.createDataFrame(a, sa), spark.createDataFrame(points, "p long, lon double, lat double")).select("a", "p")
    want = sorted((i, k) for i, q in a for k, x, y in points if q[0] <= x <= q[2] and q[1] <= y <= q[3])
    assert sorted(map(tuple, met.collect())) == want and len(want) > 150 * 300
    assert met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 9000


def copies(spark, into, times):
    """The tables of places, so many times with other keys: places and widths of boxes repeat."""
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("embeddings", "vec_id")):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        t.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(key, F.col("_i") * 3000 + F.col(key)).drop("_i").write.parquet(f"{into}/{name}.parquet")


def test_population_by_place_takes_each_box_and_place_once(spark, tmp_path, monkeypatch):
    seen, join = [], terrain.points_in_boxes
    monkeypatch.setattr(terrain, "points_in_boxes", lambda boxes, points: seen.append((boxes.count(), points.count())) or join(boxes, points))
    got = []
    for times in (1, 3):
        copies(spark, tmp_path / str(times), times)
        got.append(queries.population_by_place(spark, str(tmp_path / str(times))).collect())
    assert seen[0] == seen[1]
    one, three = ({r["lake_id"]: r for r in rows} for rows in got)
    assert len(three) == 3 * len(one) > 0
    for k, r in three.items():
        assert r["n_cells"] == 3 * one[k % 3000]["n_cells"] and r["population"] == pytest.approx(3 * one[k % 3000]["population"], abs=0.01)


def test_a_window_reads_the_files_of_its_zones(spark, tmp_path):
    rng = random.Random(6)
    points = [(k, rng.uniform(-179, 179), rng.uniform(-80, 80)) for k in range(400)] + [(5000 + k, 74.5 + k / 1e4, 36.3) for k in range(1500)]  # a hot zone
    path = str(tmp_path / "places")
    terrain.write_by_place(spark.createDataFrame(points, "p long, lon double, lat double").repartition(8), path)
    table = spark.read.parquet(path)
    window = (74.0, 36.0, 75.5, 37.0)
    found = terrain.in_window(table, *window)
    assert sorted(r["p"] for r in found.collect()) == sorted(k for k, x, y in points if 74.0 <= x <= 75.5 and 36.0 <= y <= 37.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan or "PartitionFilters: [zone" in plan
    read = table.filter(F.col("zone").isin([r[0] for r in found.select("zone").distinct().collect()])).select(F.input_file_name()).distinct().count()
    assert read < 20 < 300 < len(table.inputFiles())
    # boxes of a table
    boxes = spark.createDataFrame([(1, (74.0, 36.0, 75.5, 37.0)), (2, (-10.0, -10.0, 10.0, 10.0))], "a long, box struct<west:double,south:double,east:double,north:double>")
    met = terrain.in_boxes_by_place(boxes, table)
    assert "PartitionFilters: [zone" in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, met.select("a", "p").collect())) == sorted((a, k) for a, q in ((1, window), (2, (-10.0, -10.0, 10.0, 10.0))) for k, x, y in points if q[0] <= x <= q[2] and q[1] <= y <= q[3])
    # near places have near keys
    keys = spark.createDataFrame([(0.1, 0.1), (0.1001, 0.1001), (0.1, 60.0)], "x double, y double").select(terrain.place_key(F.col("x"), F.col("y"), 16)).collect()
    assert keys[0][0] == keys[1][0] != keys[2][0]


def pixel_table(spark, usable, n=4):
    """Pixels of scenes: clear and half water, or cloudy."""
    rows = [(i, 100, 20 if k % 2 else 300, 6 if ok else 9) for i, ok in usable.items() for k in range(n)]
    return spark.createDataFrame(rows, "scene_id long, green int, nir int, scene_class int")


def test_waves_read_what_is_still_open(spark, tmp_path):
    at = lambda d: dt.datetime(2026, 7, d)
    rows = [(lake, 100 * lake + k, at(28 - k), "s", 5.0) for lake in range(1, 6) for k in range(12)]
    df = spark.createDataFrame(rows, "lake_id long, scene_id long, acquired_at timestamp_ntz, source string, cloud_cover_pct double")
    # lakes 1 and 2 are clear at once, 3 at rank 2, 4 at rank 9, 5 never
    clear = {100, 200, 301, 408, 411}
    pixels, written = pixel_table(spark, {r[1]: r[1] in clear for r in rows}), {}

    def store(table, name):
        table.write.parquet(str(tmp_path / name))
        written[name] = spark.read.parquet(str(tmp_path / name))
        return written[name]

    got = {r["lake_id"]: r for r in sc.latest_in_waves(df, pixels, store).collect()}
    assert {k: (r["scene_id"], r["scenes_checked"]) for k, r in got.items()} == {1: (100, 1), 2: (200, 1), 3: (301, 2), 4: (408, 9), 5: (None, 12)}
    assert got[3]["area_km2"] == pytest.approx(0.0002) and got[5]["area_km2"] is None
    # scenes whose pixels were read: one of each lake, then those of open lakes alone
    assert [written[f"wave-{k}"].count() for k in range(5)] == [5, 3, 4, 8, 4 + 4]
    whole = sc.latest_usable(sc.processed(df, pixels)).select("lake_id", "scene_id", "scenes_checked", "area_km2", "error")
    assert sorted(map(tuple, whole.collect())) == sorted((k, r["scene_id"], r["scenes_checked"], r["area_km2"], r["error"]) for k, r in got.items())
    assert sc.latest_in_waves(df.filter("false"), pixels, lambda t, name: store(t, f"empty-{name}")).count() == 0


def test_faults_are_rows_of_single_lakes(spark):
    """A malformed date, cloud figure or pixel is its lake's error; the others are as without it."""
    raw = [("a", "2026-07-20 05:00:00", "5"), ("a", "2026-07-10 05:00:00", "5"), ("b", "20 July", "5"), ("b", "2026-07-10 05:00:00", "5"), ("c", "2026-07-20 05:00:00", "x"), ("d", "2026-07-20 05:00:00", "5"), ("d", "2026-07-10 05:00:00", "5"), ("d", "2026-07-01 05:00:00", "5"), ("e", "2026-07-20 05:00:00", None)]
    ids = {x: k for k, x in enumerate("abcde")}
    df = spark.createDataFrame([(ids[x], k, t, "s", p) for k, (x, t, p) in enumerate(raw)], "lake_id long, scene_id long, acquired_at string, source string, cloud_cover_pct string")
    bands = [(k, "100", "20", 6) for k in range(len(raw)) if k != 6] + [(6, "100", "?", 6), (6, "100", "20", 6)]
    pixels = spark.createDataFrame(bands, "scene_id long, green string, nir string, scene_class int")
    every = sc.processed(sc.checked(df), pixels)
    registry = spark.createDataFrame(list(ids.items()), "slug string, ordinal int")
    lakes = registry.withColumnRenamed("ordinal", "lake_id").withColumn("lake_id", F.col("lake_id").cast("long"))
    none = spark.createDataFrame([], "lake_id long, captured_at date, source string")
    new, results = runs.run_latest(registry, lakes, every, none, "2026-07-21 00:00:00")
    got = {r["slug"]: (r["observations_written"], r["scenes_checked"], r["stale"], r["error"]) for r in results.collect()}
    want = {"a": (1, 1, False, None), "b": (0, 0, True, "malformed acquired_at: 20 July"), "c": (0, 0, True, "malformed cloud_cover_pct: x"), "d": (1, 1, False, None), "e": (0, 0, True, None)}
    assert got == want and {r["scene_id"] for r in new.collect()} == {0, 5}
    # a backfill writes what comes before the fault, newest first, and counts it as checked
    new, results = runs.run_backfill(registry, lakes, every, none, "2026-01-01", "2026-12-31", "2026-07-21 00:00:00")
    got = {r["slug"]: (r["observations_written"], r["scenes_checked"], r["stale"], r["error"]) for r in results.collect()}
    assert got == want | {"a": (2, 2, False, None), "d": (1, 2, True, "malformed pixels: 1")} and {r["scene_id"] for r in new.collect()} == {0, 1, 5}
    # in waves the fault of a scene that is read stops its lake
    found = sc.latest_in_waves(sc.checked(df.filter("scene_id in (6, 7)")), pixels, lambda t, _: t)
    assert one(found.select("scene_id", "scenes_checked", "error")) == (None, 1, "malformed pixels: 1")


def test_stream_then_backfill_then_daily(spark, tmp_path):
    """Rows of all writers keep area, cloud fraction, scene and run, and are scored together."""
    registry, lakes, static, _, slope, _ = hazard_tables(spark)
    table = ob.table(spark, str(tmp_path / "obs"))
    at = lambda *days: spark.createDataFrame([(1, 10 * k + m, dt.datetime(2026, m, d), "s", 5.0) for k, (m, d) in enumerate(days)], "lake_id long, scene_id long, acquired_at timestamp_ntz, source string, cloud_cover_pct double")
    streamed = at((4, 2))
    streamed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(streamed.schema).parquet(str(tmp_path / "in"))
    ingest(stream, table.path, str(tmp_path / "ck"), pixels=pixel_table(spark, {4: True}, 8)).awaitTermination()
    past = at((4, 2), (6, 1))
    commit, results = runs.backfill(registry, lakes, sc.processed(past, pixel_table(spark, {4: True, 16: True}, 4)), table, "2026-01-01", "2026-06-30", "2026-07-01 00:00:00")
    assert commit.rows == 1 and [r["observations_written"] for r in results.orderBy("ordinal").collect()] == [1, 0, 0, 0, 0]
    today = sc.processed(at((7, 1)), pixel_table(spark, {7: True}, 16))
    for written in (1, 0):
        results, scored = runs.run_daily(registry, lakes, static, today, table, slope, "2026-07-01", "2026-07-01 12:00:00")
        assert one(results.filter("slug = 'a'").select("observations_written", "scenes_checked", "stale", "error")) == (written, 1, False, None)
    rows = {r["scene_id"]: r for r in table.read().collect()}
    assert {k: (r["area_km2"], r["cloud_fraction"], r["run_id"].split("-")[0]) for k, r in rows.items()} == {4: (0.0004, 0.0, "stream"), 16: (0.0002, 0.0, "backfill"), 7: (0.0008, 0.0, "latest")}
    assert len({r["row_id"] for r in rows.values()}) == 3
    months = features.months(table, str(tmp_path / "months"))
    _, by_month = runs.run_daily(registry, lakes, static, today, table, slope, "2026-07-01", "2026-07-01 12:00:00", months=months)
    assert sorted(map(str, by_month.collect())) == sorted(map(str, scored.collect()))
    later = at((7, 2))
    later.write.parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema(later.schema).parquet(str(tmp_path / "in2"))
    ingest(stream, table.path, str(tmp_path / "ck2"), pixels=pixel_table(spark, {7: True}, 4), months=months).awaitTermination()
    assert months.table.version().number == table.version().number and months.read().selectExpr("sum(size(days))").first()[0] == 4
    raw = json.loads(one(scored.filter("slug = 'a'"))["components"])["raw_inputs"]
    assert (raw["growth_30d_pct"], raw["growth_90d_pct"]) == (pytest.approx(3.0), pytest.approx(1.0))


def test_history_is_each_day_as_it_was_seen(spark):
    rng = random.Random(8)
    days = lambda n: D("2022-01-01") + dt.timedelta(days=n)
    rows = [(rng.randrange(4), days(rng.randrange(1500)), rng.choice("ab"), k, rng.choice([0.0, 1.0, rng.random(), None])) for k in range(700)]
    rows += [(9, days(3 * k), "a", 10_000 + k, 1.0 + k % 7) for k in range(400)]  # a hot lake
    seen = spark.createDataFrame(rows, OBS)
    asked = [(lake, days(n)) for lake in (0, 1, 2, 3, 9, 77) for n in (-5, 0, 31, 200, 547, 548, 549, 700, 1499, 2300)]
    requests = spark.createDataFrame([*asked, *asked[:3], (None, days(5)), (1, None)], "lake_id long, as_of date")
    norm = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    got = {(r["lake_id"], r["as_of"]): norm(tuple(r)[2:]) for r in asof.history(seen, requests).collect()}
    assert len(got) == len(asked) + 2 and got[None, days(5)] == got[1, None] == (None,) * 5
    for day in sorted({d for _, d in asked}):
        want = {r["lake_id"]: norm(tuple(r)[1:]) for r in features.together(ob.lookback(seen, str(day), strict=True), str(day)).collect()}
        for lake in (0, 1, 2, 3, 9, 77):
            assert got[lake, day] == want.get(lake, (None,) * 5), (lake, day)


def test_merge_keeps_no_more_than_a_block(spark):
    series = spark.createDataFrame([(1, D("2026-01-05"), (7,)), (1, D("2026-03-01"), (8,)), (2, D("2026-02-01"), (9,))], "k long, day date, v struct<x:int>")
    asks = spark.createDataFrame([(1, D("2026-01-04"), "a"), (1, D("2026-01-05"), "b"), (1, D("2026-02-20"), "c"), (1, D("2027-01-01"), "d"), (3, D("2026-02-20"), "e"), (None, D("2026-02-20"), "f")], "k long, day date, tag string")
    found = lambda **kw: {r["tag"]: r["v"] and r["v"]["x"] for r in asof.merge(asks, series, ["k"], "v", **kw).collect()}
    assert found() == {"a": None, "b": 7, "c": 7, "d": 8, "e": None, "f": None}
    assert found(forward=True) == {"a": 7, "b": 7, "c": 8, "d": None, "e": None, "f": None}
    windows = [x for x in asof.merge(asks, series, ["k"], "v")._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [" in x]
    assert len(windows) == 2  # within a block, and over the table of blocks


def test_reports_are_in_utc_wherever_the_session_is(spark):
    registry, lakes, static, seen, slope, people = hazard_tables(spark)
    done = runs.run_hazard(registry, lakes, static, seen, slope, "2026-07-20", people, "2026-07-20 00:00:00+00:00")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Karachi")
    try:
        assert {r["computedAt"] for r in runs.score_reports(done, "h").collect()} == {"2026-07-20T00:00:00+00:00"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    norm = lambda rows: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert norm(map(tuple, got.select(*columns).collect())) == norm(want.fetchall())
