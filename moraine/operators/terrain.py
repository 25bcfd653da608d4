"""Grids: slope of elevation, population in a buffer, alignment of bands."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.keyed import KeyedTable

#: The population product and the radius of the buffer.
POPULATION_SOURCE, BUFFER_KM = "worldpop_pak_2025_constrained_100m", 5.0


def gradient(cells: DataFrame, along: str, across: str, spacing: str) -> DataFrame:
    """Central difference of ``z`` inside, one-sided at the edges; null for a single cell."""
    w = Window.partitionBy("lake_id", across).orderBy(along)
    before, after = F.lag("z").over(w), F.lead("z").over(w)
    steps = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
    return cells.withColumn(f"g_{along}", (F.coalesce(after, F.col("z")) - F.coalesce(before, F.col("z"))) / (steps * F.col(spacing)))


def mean_slope(cells: DataFrame) -> DataFrame:
    """lake_id, slope_degrees from (lake_id, row, col, z, dx_m, dy_m): the mean before degrees."""
    both = gradient(gradient(cells, "col", "row", "dx_m"), "row", "col", "dy_m")
    steep = F.atan(F.sqrt(F.col("g_col") * F.col("g_col") + F.col("g_row") * F.col("g_row")))
    return both.groupBy("lake_id").agg(F.degrees(F.avg(steep)).alias("slope_degrees"))


#: Cells across a tile of :func:`mean_slope_tiled`.
TILE = 64


def mean_slope_tiled(cells: DataFrame, side: int = TILE) -> DataFrame:
    """:func:`mean_slope` of cells (lake_id, row, col, z, dx_m, dy_m), perhaps with ``tile``, a row an array.

    Cells are dealt into tiles of ``side`` by ``side``, those at its edge into the next one too (a halo of
    4 / ``side`` more rows), and that is the one shuffle before the mean: where several elevation tiles
    have a cell the first one's value counts, each row of a tile becomes one array, rows follow each other
    in a window over the tile, and gradients are taken by position.  A large lake is many tiles, and an
    array is not longer than ``side`` + 2 for each tile that covers it.  A missing cell (or a null z) is an edge: its neighbours take
    one-sided differences, where :func:`mean_slope` takes the next cell there is.
    """
    tile = lambda x: F.floor(F.col(x) / side).cast("int")
    at = lambda x: F.col(x) - tile(x) * side
    home = F.struct(tile("row").alias("r"), tile("col").alias("c"))
    beside = lambda when, r, c: F.when(when, F.struct((tile("row") + r).alias("r"), (tile("col") + c).alias("c")))
    shared = [beside(at("row") == 0, -1, 0), beside(at("row") == side - 1, 1, 0), beside(at("col") == 0, 0, -1), beside(at("col") == side - 1, 0, 1)]
    inner = at("row").between(1, side - 2) & at("col").between(1, side - 2)
    value = ["col", *[c for c in ("tile",) if c in cells.columns], "z"]
    dealt = cells.select("lake_id", F.explode(F.when(inner, F.array(home)).otherwise(F.array_compact(F.array(home, *shared)))).alias("t"), F.col("row").cast("int").alias("row"), F.struct(*value).alias("v"), "dx_m", "dy_m")
    key = ["lake_id", "tr", "tc"]
    dealt = dealt.select("lake_id", F.col("t.r").alias("tr"), F.col("t.c").alias("tc"), "row", "v", "dx_m", "dy_m").repartition(*key)
    strips = dealt.groupBy(*key, "row").agg(F.array_sort(F.collect_list("v")).alias("cells"), F.max("dx_m").alias("dx_m"), F.max("dy_m").alias("dy_m"))
    if "tile" in cells.columns:
        first = F.filter("cells", lambda x, i: (i == 0) | (F.get("cells", i - 1)["col"] != x["col"]))
        strips = strips.withColumn("cells", first)
    # z by position from the first column on; where columns are missing, with nulls
    start, end = F.element_at("cells", 1)["col"], F.element_at("cells", -1)["col"]
    filled = F.transform(F.sequence(start, end), lambda c: F.get(F.filter("cells", lambda x: x["col"] == c), 0)["z"])
    strips = strips.select(*key, "row", "dx_m", "dy_m", start.alias("start"), F.when(F.size("cells") == end - start + 1, F.col("cells.z")).otherwise(filled).alias("z"))
    rows = Window.partitionBy(*key).orderBy("row")
    near = lambda f, step: F.when(f("row").over(rows) == F.col("row") + step, F.struct(f("start").over(rows).alias("start"), f("z").over(rows).alias("z")))
    strips = strips.withColumns({"above": near(F.lag, -1), "below": near(F.lead, 1)}).filter(tile("row") == F.col("tr"))

    def beside_z(strip: str) -> Column:
        """The array of another strip, shifted so that its columns stand where this strip's do."""
        shift = F.col(f"{strip}.start") - F.col("start")
        there = F.col(f"{strip}.z")
        return F.when(shift == 0, there).when(shift > 0, F.concat(F.array_repeat(F.lit(None).cast("double"), shift), there)).otherwise(F.slice(there, 1 - shift, F.size(there)))

    none = F.array(F.lit(None).cast("double"))
    around = {"z": F.col("z"), "left": F.concat(none, "z"), "right": F.slice("z", 2, F.size("z")), "up": beside_z("above"), "down": beside_z("below")}
    # arrays that end sooner, or are not there, are nulls
    zipped = strips.select("lake_id", "tc", "dx_m", "dy_m", F.sequence("start", F.col("start") + F.size("z") - 1).alias("col"), *[F.coalesce(v, none).alias(k) for k, v in around.items()])
    each = zipped.select("lake_id", "tc", "dx_m", "dy_m", F.inline(F.arrays_zip("col", *around)))

    def change(before: str, after: str, spacing: str) -> Column:
        steps = F.when(F.col(before).isNull() | F.col(after).isNull(), 1.0).otherwise(2.0)
        return (F.coalesce(after, "z") - F.coalesce(before, "z")) / (steps * F.col(spacing))

    across, along = change("left", "right", "dx_m"), change("up", "down", "dy_m")
    # of a strip its own cells: neither the halo nor what is missing
    steep = F.when((tile("col") == F.col("tc")) & F.col("z").isNotNull(), F.atan(F.sqrt(across * across + along * along)))
    return each.groupBy("lake_id").agg(F.degrees(F.avg(steep)).alias("slope_degrees"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """Cells (lake_id, tile, row, col, z) of overlapping tiles: of a cell the first tile's value."""
    return tiles.groupBy("lake_id", "row", "col").agg(F.min(F.struct("tile", "z")).alias("t")).select("lake_id", "row", "col", F.col("t.z").alias("z"))


def tiles_of(lakes: DataFrame, tiles: DataFrame) -> DataFrame:
    """(lake_id, tile): the elevation tiles (tile, box) that overlap a lake's box, each once."""
    return boxes_meet(lakes.select("lake_id", "box"), tiles.select("tile", F.col("box").alias("other"))).select("lake_id", "tile")


def lake_elevation(lakes: DataFrame, tiles: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """(lake_id, row, col, z): elevation in each lake's box (lake_id, box), cut from the cells (tile, lon,
    lat, z) of the tiles that overlap it; where tiles overlap, the first tile's value counts.  A lake
    that no tile covers has no rows, and so an error row in the hazard pass."""
    return mosaic(_cut(lakes, tiles, cells, step).drop("box"))


def _cut(lakes: DataFrame, tiles: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """(lake_id, tile, row, col, z, box): each tile's cells in a lake's box, in rows from north to south."""
    inside = tiles_of(lakes, tiles).join(cells, "tile").join(lakes.select("lake_id", "box"), "lake_id").filter(geo.contains(F.col("box"), F.col("lon"), F.col("lat")))
    return inside.select("lake_id", "tile", (-geo.cell(F.col("lat"), step)).alias("row"), geo.cell(F.col("lon"), step).alias("col"), "z", "box")


def lake_slopes(lakes: DataFrame, tiles: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """(lake_id, slope_degrees) of each lake's box from the elevation tiles that overlap it, cell sizes as in the
    middle of the box.  Cut, mosaic and slope in one shuffle; a lake that no tile covers has no row."""
    cut = _cut(lakes, tiles, cells, step)
    size = geo.pixel_metres(F.lit(step), F.lit(step), (F.col("box.south") + F.col("box.north")) / 2)
    return mean_slope_tiled(cut.select("lake_id", "tile", "row", "col", "z", size["dx_m"].alias("dx_m"), size["dy_m"].alias("dy_m")))


def box_key(box: Column) -> Column:
    """A box as text, to about 0.1 m: what is remembered of it is found again by this."""
    return F.format_string("%.6f %.6f %.6f %.6f", *[box[x].cast("double") for x in ("west", "south", "east", "north")])


def slope_memo(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, "box_key string, slope_degrees double", ["box_key"])


def remembered(lakes: DataFrame, memo: KeyedTable, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(lake_id, slope_degrees) of ``lakes`` (lake_id, box): from ``memo``, and for boxes that it does not have
    from ``make``, which gets these alone as (lake_id, box) and gives (lake_id, slope_degrees).

    Terrain does not change, so a slope is computed once for a box; a lake that comes later costs its own
    tiles only.  A box without a slope is not remembered and asked for again.  Runs at the same time may
    compute one twice; the first that is written stays.
    """
    keyed = lakes.select("lake_id", "box", box_key(F.col("box")).alias("box_key"))
    missing = keyed.join(memo.read().select("box_key"), "box_key", "left_anti")
    if not missing.isEmpty():
        one = missing.groupBy("box_key").agg(F.min(F.struct("lake_id", "box")).alias("o")).select("box_key", "o.lake_id", "o.box")
        made = make(one.select("lake_id", "box")).filter("slope_degrees is not null")
        memo.append(made.join(one.select("lake_id", "box_key"), "lake_id"))
    return keyed.join(memo.read(), "box_key", "left").select("lake_id", "slope_degrees")


#: The finest level of the quadtree: cells of 360 / 2**24 degrees, 2 m.
FINEST = 24


def _side(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def level_of(box: Column) -> Column:
    """The finest level whose cells are no smaller than the box, which so overlaps 2 x 2 of them at most."""
    widest = F.greatest(box["east"] - box["west"], box["north"] - box["south"])
    return F.when(widest > 0, F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(360.0) / widest))))).otherwise(F.lit(FINEST)).cast("int")


def with_level_cell(df: DataFrame, lon: Column, lat: Column) -> DataFrame:
    """Adds the cell (cx, cy) of ``level`` that a point falls in."""
    return df.withColumns({"cx": F.floor(lon / _side(F.col("level"))).cast("int"), "cy": F.floor(lat / _side(F.col("level"))).cast("int")})


def cover(boxes: DataFrame, box: str = "box") -> DataFrame:
    """One row for each cell of ``level`` that ``box`` overlaps."""
    side = _side(F.col("level"))
    span = lambda a, b: F.sequence(F.floor(F.col(f"{box}.{a}") / side).cast("int"), F.floor(F.col(f"{box}.{b}") / side).cast("int"))
    return boxes.withColumn("cx", F.explode(span("west", "east"))).withColumn("cy", F.explode(span("south", "north")))


def _levels(boxes: DataFrame, box: str) -> list[int]:
    """The levels that occur: FINEST + 1 at most."""
    return sorted(r[0] for r in boxes.select(level_of(F.col(box)).alias("level")).distinct().collect())


#: Comparisons in one piece of a crowded cell, and in one task of a join by cells, about; rows of such a task.
PIECE, TASK, TASK_ROWS = 16_000_000, 64_000_000, 1_000_000

#: Crowded cells that are broadcast, at most.
CROWDED = 1_000_000

_CELL = ["level", "cx", "cy"]


def _compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Joins rows placed in cells: each of ``left`` with each of ``right`` in its cell, in tasks of about equal work.

    A cell with more than PIECE pairs to compare is dealt: each side is cut by a hash of its rows into pieces,
    of about the root of PIECE rows where both sides have many, and each piece of one side meets each of the
    other apart.  There are as many tasks as the comparisons need, so that none grows with the tables, and no
    side is broadcast.  Rows equal in all columns stay together.
    """
    count = lambda df, n: df.groupBy(_CELL).agg(F.count(F.lit(1)).cast("double").alias(n))
    cells = count(left, "_n").join(count(right, "_m"), _CELL, "full").withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("_n", "_m")})
    crowded = F.col("_n") * F.col("_m") > PIECE
    pairs, rows, n_crowded = cells.agg(F.sum(F.col("_n") * F.col("_m")), F.sum(F.col("_n") + F.col("_m")), F.count_if(crowded)).first()
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, math.ceil((pairs or 0) / TASK), math.ceil((rows or 0) / TASK_ROWS))
    if n_crowded:
        cut = lambda n, m: F.ceil(F.col(n) / F.greatest(F.lit(math.sqrt(PIECE)), PIECE / F.col(m)))
        dealt = cells.filter(crowded).select(*_CELL, cut("_n", "_m").alias("_ln"), cut("_m", "_n").alias("_rn"))
        dealt = F.broadcast(dealt) if n_crowded <= CROWDED else dealt

    def deal(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        if not n_crowded:
            return df.repartition(tasks, *_CELL)
        piece, n = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"{mine}n", F.lit(1))), F.coalesce(f"{theirs}n", F.lit(1))
        copies = df.join(dealt, _CELL, "left").withColumns({mine: piece, theirs: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))})
        return copies.select(*df.columns, "_l", "_r").repartition(tasks, *_CELL, "_l", "_r")

    key = [*_CELL, "_l", "_r"] if n_crowded else _CELL
    return deal(left, "_l", "_r").join(deal(right, "_r", "_l").hint("merge"), key).drop("_l", "_r")


def points_in_boxes(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """Range join of rows with a box with points (lon, lat).

    Boxes may have any size: each is 4 rows at most, of cells as large as itself, and a point one row
    for each level that occurs among the boxes.  A point meets a box in one cell.
    """
    levels = F.array(*map(F.lit, _levels(boxes, "box"))).cast("array<int>")
    placed = with_level_cell(points.withColumn("level", F.explode(levels)), F.col("lon"), F.col("lat"))
    joined = _compared(cover(boxes.withColumn("level", level_of(F.col("box")))), placed)
    return joined.filter(geo.contains(F.col("box"), F.col("lon"), F.col("lat"))).drop(*_CELL)


def boxes_meet(a: DataFrame, b: DataFrame, box: str = "box", other: str = "other") -> DataFrame:
    """The pairs of rows of ``a`` with a ``box`` and of ``b`` with a box ``other`` that overlap, each once.

    Two boxes are compared in cells of the larger one's level: each box is in cells of its own level and
    of those coarser ones that the other side has, 4 of each at most.  Of the cells that two share, the
    one with the south-west corner of what they share counts, so no pair has to be made distinct.
    """

    def placed(df: DataFrame, name: str, theirs: list[int], mine: str) -> DataFrame:
        own = df.withColumn(mine, level_of(F.col(name)))
        coarser = F.filter(F.array(*map(F.lit, theirs)).cast("array<int>"), lambda x: x < F.col(mine))
        return cover(own.withColumn("level", F.explode(F.array_union(F.array(F.col(mine)), coarser))), name)

    left, right = placed(a, box, _levels(b, other), "_own"), placed(b, other, _levels(a, box), "_their")
    met = _compared(left.withColumn("_side", _side(F.col("level"))), right).filter(F.col("level") == F.least("_own", "_their"))
    met = met.filter(geo.intersects(F.col(box), F.col(other)))
    corner = lambda x: F.greatest(F.col(f"{box}.{x}"), F.col(f"{other}.{x}"))
    first = (F.floor(corner("west") / F.col("_side")).cast("int") == F.col("cx")) & (F.floor(corner("south") / F.col("_side")).cast("int") == F.col("cy"))
    return met.filter(first).drop(*_CELL, "_own", "_their", "_side")


#: Level of the zones by which a table of places is laid out (1.4 degrees), and of the order in them.
ZONE_LEVEL, PLACE_LEVEL = 8, 16


def place_key(lon: Column, lat: Column, level: int) -> Column:
    """The place on a space-filling curve (Z order) over the cells of ``level``: near places have near keys."""
    side = 360.0 / 2**level
    x, y = F.floor((lon + 180.0) / side).cast("long"), F.floor((lat + 180.0) / side).cast("long")
    key = F.lit(0).cast("long")
    for i in range(level):
        bit = lambda v: F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long"))  # noqa: E731, B023
        key = key.bitwiseOR(F.shiftleft(bit(x), 2 * i)).bitwiseOR(F.shiftleft(bit(y), 2 * i + 1))
    return key


def write_by_place(places: DataFrame, path: str) -> None:
    """Write a table with lon, lat by zones, in files of near places: a zone is a folder, and one with many
    rows has several files, cut along the curve."""
    keyed = places.withColumns({"zone": place_key(F.col("lon"), F.col("lat"), ZONE_LEVEL), "place": place_key(F.col("lon"), F.col("lat"), PLACE_LEVEL)})
    keyed.repartitionByRange("zone", "place").sortWithinPartitions("zone", "place").write.partitionBy("zone").parquet(path)


def zones_of(box: Column) -> Column:
    """The zones that a box overlaps, as an array."""
    side = 360.0 / 2**ZONE_LEVEL
    span = lambda a, b: F.sequence(F.floor((box[a] + 180.0) / side).cast("int"), F.floor((box[b] + 180.0) / side).cast("int"))
    middle = lambda i: (i + 0.5) * side - 180.0
    return F.flatten(F.transform(span("west", "east"), lambda x: F.transform(span("south", "north"), lambda y: place_key(middle(x), middle(y), ZONE_LEVEL))))


#: Zones that a filter names, at most; boxes over more of them open all folders.
NAMED_ZONES = 4096


def _of_zones(places: DataFrame, zones: DataFrame) -> DataFrame:
    """The folders of a table written by :func:`write_by_place` that some zones need: others are not opened."""
    found = [r["zone"] for r in zones.distinct().limit(NAMED_ZONES + 1).collect()]
    return places.filter(F.col("zone").isin(found)) if len(found) <= NAMED_ZONES else places


def in_window(places: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of a table written by :func:`write_by_place` within a window: folders of other zones are not
    opened, and row groups of other places are skipped by the ranges of lon and lat."""
    box = F.struct(F.lit(west).alias("west"), F.lit(south).alias("south"), F.lit(east).alias("east"), F.lit(north).alias("north"))
    near = _of_zones(places, places.sparkSession.range(1).select(F.explode(zones_of(box)).alias("zone")))
    return near.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def in_boxes_by_place(boxes: DataFrame, places: DataFrame) -> DataFrame:
    """:func:`points_in_boxes` with a table written by :func:`write_by_place`: only the folders of zones that
    ``boxes`` overlap are opened."""
    return points_in_boxes(boxes, _of_zones(places, boxes.select(F.explode(zones_of(F.col("box"))).alias("zone"))))


def totals_in_boxes(boxes: DataFrame, places: DataFrame) -> DataFrame:
    """(box, n, p) of each box with a cell in it: its cells (lon, lat, pop) and their people; negative counts 0.
    Each place and each box once in the range join, however many rows have them."""
    at = places.groupBy("lon", "lat").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("pop").cast("double"), F.lit(0.0))).alias("p"))
    return points_in_boxes(boxes.select("box").distinct(), at).groupBy("box").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def totals_by_place(boxes: DataFrame, places: DataFrame) -> DataFrame:
    """:func:`totals_in_boxes` with a table written by :func:`write_by_place`: of it the zones of ``boxes`` are read."""
    each = boxes.select("box").distinct()
    return totals_in_boxes(each, _of_zones(places, each.select(F.explode(zones_of(F.col("box"))).alias("zone"))))


def exposure(lakes: DataFrame, population: DataFrame, radius_km: float) -> DataFrame:
    """lake_id, population: of cells in the buffer box; negative (no data) counts 0, no cells 0."""
    boxes = lakes.select("lake_id", geo.buffer_box(F.col("lon"), F.col("lat"), F.lit(radius_km)).alias("box"))
    return boxes.join(totals_in_boxes(boxes, population), "box", "left").select("lake_id", F.coalesce("p", F.lit(0.0)).alias("population"))


def exposure_document(population: Column, radius_km: float = BUFFER_KM) -> Column:
    """What a hazard document says of exposure; population to one place."""
    return F.struct(
        F.lit(POPULATION_SOURCE).alias("source"), F.lit(radius_km).alias("buffer_km"), F.lit("square").alias("buffer_shape"), F.bround(population, 1).alias("population_within_buffer"),
        F.lit("A square around the lake, not routed along the flow path.").alias("note"),
    )


def upsample(band: DataFrame, factor: int = 2) -> DataFrame:
    """Nearest-neighbour: each cell (row, col) becomes factor x factor cells."""
    offsets = F.sequence(F.lit(0), F.lit(factor - 1))
    wide = band.withColumn("_r", F.explode(offsets)).withColumn("_c", F.explode(offsets))
    return wide.withColumns({"row": F.col("row") * factor + F.col("_r"), "col": F.col("col") * factor + F.col("_c")}).drop("_r", "_c")


def align(fine: DataFrame, coarse: DataFrame, keys: list[str], factor: int = 2) -> DataFrame:
    """Joins a coarse band to a fine one cell by cell, cropped to what both have: without an
    upsampled copy, each fine cell looks up its coarse one."""
    at = fine.withColumns({"_r": F.floor(F.col("row") / factor).cast("int"), "_c": F.floor(F.col("col") / factor).cast("int")})
    return at.join(coarse.withColumnsRenamed({"row": "_r", "col": "_c"}), [*keys, "_r", "_c"]).drop("_r", "_c")
