"""Normalised risks, weighted score, tier.

Where the method's prose and its computation differ the computation is followed: the two growth
windows are clamped as a sum, not each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of methodology 1.0.
METHODOLOGY_VERSION = "1.0"
WEIGHTS = {"area_growth": 0.30, "historical_glof": 0.15, "dam_type": 0.20, "glacier_contact": 0.10, "slope": 0.10, "seasonal_anomaly": 0.15}
TIERS = ((0.65, "critical"), (0.45, "high"), (0.25, "watch"), (0.0, "normal"))
DAM_TYPES = {"moraine": 1.0, "ice": 0.8, "unknown": 0.5, "bedrock": 0.2}
GROWTH_SATURATION, SEASONAL_SATURATION, SLOPE_SATURATION, NO_CONTACT = 0.5, 0.3, 40.0, 0.3


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _positive(x: Column) -> Column:
    """max(x, 0), and 0 for a missing signal: clamp01 would make 1 of a null."""
    return F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0))


def dam_recognised(dam_type: Column) -> Column:
    return F.coalesce(dam_type.isin(*DAM_TYPES), F.lit(False))


def dam_risk(dam_type: Column) -> Column:
    """By exact name; anything else counts as unknown (see dam_recognised)."""
    risk = F.lit(DAM_TYPES["unknown"])
    for name, value in DAM_TYPES.items():
        risk = F.when(dam_type == name, F.lit(value)).otherwise(risk)
    return risk


def growth_risk(g30: Column, g90: Column) -> Column:
    return clamp01(F.lit(0.5) * _positive(g30) / GROWTH_SATURATION + F.lit(0.5) * _positive(g90) / GROWTH_SATURATION)


def anomaly_risk(anomaly: Column) -> Column:
    return clamp01(_positive(anomaly) / SEASONAL_SATURATION)


def contact_risk(contact: Column) -> Column:
    return F.when(F.coalesce(contact, F.lit(False)), 1.0).otherwise(F.lit(NO_CONTACT))


def glof_risk(glof: Column) -> Column:
    return F.when(F.coalesce(glof, F.lit(False)), 1.0).otherwise(F.lit(0.0))


def slope_risk(slope_degrees: Column) -> Column:
    """Null where there is no slope: such a lake has no score, rather than the greatest or no risk."""
    return F.when(slope_degrees.isNotNull(), clamp01(slope_degrees / SLOPE_SATURATION))


def compensated_sum(terms: list[Column]) -> Column:
    """Sum of doubles that carries the rounding error along, so that tier borders are met exactly."""

    def step(acc: Column, x: Column) -> Column:
        t = acc["s"] + x
        lost = F.when(F.abs(acc["s"]) >= F.abs(x), (acc["s"] - t) + x).otherwise((x - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    return F.aggregate(F.array(*terms), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), step, lambda acc: acc["s"] + acc["c"])


def score(risks: dict[str, Column]) -> Column:
    """Null if a risk is null."""
    return compensated_sum([F.lit(w) * risks[name] for name, w in WEIGHTS.items()])


def tier(value: Column) -> Column:
    out = F.lit(TIERS[-1][1])
    for threshold, name in reversed(TIERS[:-1]):
        out = F.when(value >= threshold, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)
