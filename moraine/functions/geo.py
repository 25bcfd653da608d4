"""Boxes and grids in degrees and metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: metres of a degree of latitude.
M_PER_DEGREE = 111320.0


def box(lon: Column, lat: Column, half_width: Column) -> Column:
    """Struct west, south, east, north."""
    return F.struct((lon - half_width).alias("west"), (lat - half_width).alias("south"), (lon + half_width).alias("east"), (lat + half_width).alias("north"))


def grid_size(b: Column, pixel_m: float = 10.0) -> Column:
    """Struct width, height in pixels, 1 at least; halves round to even."""
    mid = F.radians((b["south"] + b["north"]) / 2)
    across = (b["east"] - b["west"]) * M_PER_DEGREE * F.cos(mid)
    up = (b["north"] - b["south"]) * M_PER_DEGREE
    pixels = lambda m: F.greatest(F.lit(1), F.bround(m / pixel_m).cast("int"))
    return F.struct(pixels(across).alias("width"), pixels(up).alias("height"))


def pixel_metres(step_x: Column, step_y: Column, mid_lat: Column) -> Column:
    """Struct dx_m, dy_m of a raster with steps in degrees."""
    return F.struct((F.abs(step_x) * M_PER_DEGREE * F.cos(F.radians(mid_lat))).alias("dx_m"), (F.abs(step_y) * M_PER_DEGREE).alias("dy_m"))


def buffer_box(lon: Column, lat: Column, radius_km: Column) -> Column:
    """The square that holds a circle around a point."""
    d = radius_km * 1000.0 / M_PER_DEGREE
    dx = d / F.cos(F.radians(lat))
    return F.struct((lon - dx).alias("west"), (lat - d).alias("south"), (lon + dx).alias("east"), (lat + d).alias("north"))


def cell(x: Column, step: float) -> Column:
    """Number of the raster cell, ``step`` degrees wide, that a coordinate at its corner belongs to."""
    return F.round(x / step).cast("int")


def intersects(a: Column, b: Column) -> Column:
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def contains(b: Column, lon: Column, lat: Column) -> Column:
    return lon.between(b["west"], b["east"]) & lat.between(b["south"], b["north"])
