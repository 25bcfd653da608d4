"""Pixel expressions: water index, usable mask, water, encoding, areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that hide the ground (shadow, cloud, dense cloud, cirrus).
UNUSABLE_CLASSES = (3, 8, 9, 10)
#: Fixed value: square metres of a pixel.
PIXEL_M2 = 100.0


def water_index(green: Column, nir: Column) -> Column:
    """(G - N) / (G + N) in single precision, 0 where the sum is 0."""
    g, n = green.cast("float"), nir.cast("float")
    return F.when(g + n != 0, ((g - n) / (g + n)).cast("float")).otherwise(F.lit(0.0).cast("float"))


def usable(scene_class: Column) -> Column:
    return ~scene_class.isin(*UNUSABLE_CLASSES)


def is_water(index: Column, mask: Column | None = None, threshold: float = 0.0) -> Column:
    wet = index > F.lit(threshold)
    return wet if mask is None else wet & mask


def water_area_km2(wet: Column) -> Column:
    """Aggregate: 0.0 for no pixels."""
    return F.count_if(wet) * F.lit(PIXEL_M2) / F.lit(1e6)


def cloud_fraction(mask: Column) -> Column:
    """Aggregate: the share of unusable pixels, 1.0 for no pixels."""
    return F.coalesce(F.try_divide(F.count_if(~mask).cast("double"), F.count(mask).cast("double")), F.lit(1.0))


def encode_dn(value: Column) -> Column:
    """Digital number of a sample: 0 if missing, a reflectance up to 1 by 10000, else rounded."""
    v = F.coalesce(value, F.lit(0.0))
    return F.when(v <= 1, F.floor(v * 10000 + 0.5)).otherwise(F.floor(v + 0.5)).cast("int")
