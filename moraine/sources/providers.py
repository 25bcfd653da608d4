"""Where scenes and their pixels come from: the provider contract and the choice of one.

A provider gives tables.  What a catalogue or a raster store needs (tokens, signed links, decoding)
belongs to a provider of its own, outside this package.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting that names the provider, and the label that observations get by default.
SETTING, DEFAULT_LABEL = "spark.moraine.source", "sentinel2-cdse"


class SceneProvider(Protocol):
    """Scenes (lake_id, scene_id, acquired_at, source, cloud_cover_pct, ...) and pixels (scene_id, green,
    nir, scene_class), the bands of a pixel aligned."""

    def scenes(self) -> DataFrame: ...

    def pixels(self) -> DataFrame: ...


class Tables:
    """Scenes and pixels that are tables already."""

    def __init__(self, scenes: DataFrame, pixels: DataFrame, label: str = DEFAULT_LABEL):
        self._scenes = scenes if "source" in scenes.columns else scenes.withColumn("source", F.lit(label))
        self._pixels = pixels

    def scenes(self) -> DataFrame:
        return self._scenes

    def pixels(self) -> DataFrame:
        return self._pixels


def choose(spark: SparkSession, known: dict[str, Callable[[], SceneProvider]], default: str, name: str | None = None) -> SceneProvider:
    """The provider ``name``, else the one that the session's setting names, else the default; only the
    chosen one is made.  An unknown name is an error that lists the known ones."""
    wanted = name or spark.conf.get(SETTING, default)
    if wanted not in known:
        raise ValueError(f"unknown source {wanted!r}; known: {', '.join(sorted(known))}")
    return known[wanted]()
