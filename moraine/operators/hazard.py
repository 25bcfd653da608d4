"""The hazard pass: features, terrain, exposure and static fields to risks, score, tier, document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from . import features, observations, terrain

RISKS = tuple(risk.WEIGHTS)


#: Why a lake has no score.
NO_STATIC = "lake row found but static fields (damType/glacierContact/historicalGlof) are NULL"
NO_SLOPE = "no elevation tile covers the lake"


def inputs(lakes: DataFrame, obs: DataFrame, slope: DataFrame, as_of: str, strict: bool = False, exposure: DataFrame | None = None, months: bool = False) -> DataFrame:
    """One row for each of ``lakes`` (lake_id, slug, static fields, perhaps ``error``).

    A lake without observations has null features and is scored.  ``error`` says why a lake is not:
    what it said before, then that no slope is known.  ``exposure``: (lake_id, population).  With ``months``,
    ``obs`` are the observations by lake and month (:func:`features.months`).
    """
    found = features.from_months(obs, as_of, strict) if months else features.together(observations.lookback(obs, as_of, strict), as_of)
    rows = lakes.join(found, "lake_id", "left").join(slope, "lake_id", "left")
    if exposure is not None:
        rows = rows.join(exposure.select("lake_id", terrain.exposure_document(F.col("population")).alias("exposure")), "lake_id", "left")
    known = F.col("error") if "error" in lakes.columns else F.lit(None).cast("string")
    return rows.withColumn("error", F.coalesce(known, F.when(F.col("slope_degrees").isNull(), F.lit(NO_SLOPE))))


def with_static(known: DataFrame, static: DataFrame) -> DataFrame:
    """``known`` (slug, lake_id, error) with the static fields of ``static`` (lake_id, dam_type,
    glacier_contact, historical_glof).  A missing row is an error; a row with nulls is not."""
    joined = known.join(static.withColumn("_there", F.lit(True)), "lake_id", "left")
    missing = F.when(F.col("_there").isNull(), F.lit(NO_STATIC))
    return joined.withColumn("error", F.coalesce("error", missing)).drop("_there")


def risks(rows: DataFrame) -> DataFrame:
    """Adds risk_* columns, score and tier; these two are null for a row with an error."""
    found = {
        "area_growth": risk.growth_risk(F.col("growth_30"), F.col("growth_90")),
        "historical_glof": risk.glof_risk(F.col("historical_glof")),
        "dam_type": risk.dam_risk(F.col("dam_type")),
        "glacier_contact": risk.contact_risk(F.col("glacier_contact")),
        "slope": risk.slope_risk(F.col("slope_degrees")),
        "seasonal_anomaly": risk.anomaly_risk(F.col("anomaly")),
    }
    out = rows.withColumns({f"risk_{k}": v for k, v in found.items()})
    found = risk.score({k: F.col(f"risk_{k}") for k in RISKS})
    out = out.withColumn("score", F.when(F.col("error").isNull(), found) if "error" in rows.columns else found)
    return out.withColumn("tier", risk.tier(F.col("score")))


def components(scored: DataFrame, as_of: str) -> DataFrame:
    """Adds ``components``: the JSON document from which a score can be recomputed; nulls are shown.  Null
    for a row without a score."""
    raw = F.struct(
        F.col("growth_30").alias("growth_30d_pct"),
        F.col("growth_90").alias("growth_90d_pct"),
        F.col("anomaly").alias("seasonal_anomaly_pct"),
        "dam_type",
        "glacier_contact",
        F.col("slope_degrees").alias("slope_deg"),
        "historical_glof",
    )
    # pairs of a number and a name, which no array type can hold
    thresholds = F.parse_json(F.lit(json.dumps(risk.TIERS)))
    weights = F.create_map(*[F.lit(x) for kv in risk.WEIGHTS.items() for x in kv])
    normal = F.create_map(*[x for k in RISKS for x in (F.lit(k), F.col(f"risk_{k}"))])
    exposure = F.col("exposure") if "exposure" in scored.columns else F.lit(None).cast("struct<population_within_buffer:double>")
    document = F.struct(
        F.lit(risk.METHODOLOGY_VERSION).alias("methodology_version"), F.lit(as_of).alias("as_of"), weights.alias("weights"), thresholds.alias("tier_thresholds"),
        raw.alias("raw_inputs"), normal.alias("normalized_risks"), exposure.alias("exposure"),
    )
    return scored.withColumn("components", F.when(F.col("score").isNotNull(), F.to_json(document, {"ignoreNullFields": "false"})))
