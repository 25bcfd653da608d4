"""Given tables in the roles of lakes, observations, scenes, pixels and grids.

This exercises the operators; the values have no physical meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF, NOW = "2001-06-30", "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("moraine", "ice", "unknown", "bedrock", "Moraine")))
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.cast("long").alias("lake_id"), F.lower("n_name").alias("slug"), F.get(kinds, F.col("n_regionkey")).alias("dam_type"),
        (n % 2 == 0).alias("glacier_contact"), (n % 3 == 0).alias("historical_glof"),
    )


def _orders(spark: SparkSession, sf_dir: str, lake: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col(lake).cast("long").alias("lake_id"), F.to_date("o_orderdate").alias("captured_at"), F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("scene_id"), (F.col("o_totalprice") / 100000).alias("area_km2"))


def observations(spark: SparkSession, sf_dir: str, lake: str = "c_nationkey") -> DataFrame:
    """One row a lake, day and source: the highest order key."""
    best = _orders(spark, sf_dir, lake).groupBy("lake_id", "captured_at", "source").agg(F.max(F.struct("scene_id", "area_km2")).alias("b"))
    return best.select("lake_id", "captured_at", "source", "b.scene_id", "b.area_km2")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("lake_id"), F.col("event_id").alias("scene_id"), F.col("ts").alias("acquired_at"), F.col("event_type").alias("source"),
        F.col("value").alias("cloud_cover_pct"), (F.col("value") / 100).alias("cloud_fraction"),
    )


def order_scenes(spark: SparkSession, sf_dir: str, lake: str = "o_custkey") -> DataFrame:
    """Orders as scenes of their customers, whose pixels are their lines: cloud and water are not known yet."""
    return table(spark, sf_dir, "orders").select(
        F.col(lake).cast("long").alias("lake_id"), F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("acquired_at"),
        F.col("o_orderpriority").alias("source"), (F.col("o_orderkey") % 100).cast("double").alias("cloud_cover_pct"),
    )


def raw_scenes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """:func:`order_scenes` and their pixels as text, of which some are malformed: a date of each 211 orders, a
    cloud figure of each 307, a pixel of each 101 orders' first line."""
    key = F.col("scene_id")
    raw = order_scenes(spark, sf_dir).withColumns({
        "acquired_at": F.when(key % 211 == 0, F.lit("no date")).otherwise(F.col("acquired_at").cast("string")),
        "cloud_cover_pct": F.when(key % 307 == 0, F.lit("cloudy")).otherwise(F.col("cloud_cover_pct").cast("string")),
    })
    broken = (F.col("l_orderkey") % 101 == 0) & (F.col("l_linenumber") == 1)
    bands = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scene_id"), F.when(broken, F.lit("-")).otherwise((F.col("l_quantity") * 200).cast("string")).alias("green"),
        (F.col("l_extendedprice") / 10).cast("string").alias("nir"), (F.col("l_linenumber") + 4).alias("scene_class"),
    )
    return raw, bands


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), (F.col("l_quantity") * 200).alias("green"), (F.col("l_extendedprice") / 10).alias("nir"), (F.col("l_linenumber") + 4).alias("scene_class"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lake_id, row, col, v: the first 64 values of each vector as 8 x 8 cells."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("lake_id"), F.posexplode("embedding").alias("i", "v")).filter("i < 64")
    return cells.select("lake_id", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), F.col("v").cast("double").alias("v"))


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("lake_id", "row", "col", (3000 + 100 * F.col("v")).alias("z"), F.lit(30.0).alias("dx_m"), F.lit(30.0).alias("dy_m"))


def placed(df: DataFrame, key: str) -> DataFrame:
    """Adds lon, lat: a place for each key, in steps of 0.01 degrees."""
    k = F.col(key)
    return df.withColumns({"lon": 70 + (k * 37 % 1000) / 100.0, "lat": 30 + (k * 91 % 1000) / 100.0})


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lon, lat, pop: each vector's grid as cells of 0.002 degrees from its place on."""
    g = placed(grid(spark, sf_dir), "lake_id")
    return g.select((F.col("lon") + F.col("col") * 0.002).alias("lon"), (F.col("lat") + F.col("row") * 0.002).alias("lat"), (100 * F.col("v")).alias("pop"))


#: Tiles of elevation lie so many degrees apart, each 8 cells of CELL wide: neighbours overlap.
TILE_STEP, CELL, TILE_ROW = 0.01, 0.002, 50


def elevation_tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tile, box) and (tile, lon, lat, z): each vector's grid as a tile, in rows of TILE_ROW tiles."""
    g = grid(spark, sf_dir).withColumnRenamed("lake_id", "tile")
    west, south = 70 + (F.col("tile") % TILE_ROW) * TILE_STEP, 30 + F.floor(F.col("tile") / TILE_ROW) * TILE_STEP
    edge = lambda at: at + 7 * CELL
    box = F.struct(west.alias("west"), south.alias("south"), edge(west).alias("east"), edge(south).alias("north"))
    tiles = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile")).select("tile", box.alias("box"))
    cells = g.select("tile", (west + F.col("col") * CELL).alias("lon"), (south + F.col("row") * CELL).alias("lat"), (3000 + 100 * F.col("v")).alias("z"))
    return tiles, cells


def customer_lakes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registry (slug, ordinal): all customers; seeded (slug, lake_id): those with an urgent order;
    static rows (lake_id, ...): those whose account is not overdrawn."""
    c = table(spark, sf_dir, "customer")
    registry = c.select(F.col("c_name").alias("slug"), F.col("c_custkey").alias("ordinal"))
    ordered = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    seeded = c.join(ordered, "c_custkey").select(F.col("c_name").alias("slug"), F.col("c_custkey").cast("long").alias("lake_id"))
    static = c.filter("c_acctbal >= 0").select(
        F.col("c_custkey").cast("long").alias("lake_id"), dam_type(F.col("c_nationkey")).alias("dam_type"),
        (F.col("c_mktsegment") == "MACHINERY").alias("glacier_contact"), (F.col("c_acctbal") > 5000).alias("historical_glof"),
    )
    return registry, seeded, static


def dam_type(key: Column) -> Column:
    """A dam type for a nation's key; one of the five is not a known name."""
    return F.get(F.array(*map(F.lit, ("moraine", "ice", "unknown", "bedrock", "Moraine"))), (key % 5).cast("int"))
