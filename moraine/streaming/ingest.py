"""Scenes as a stream: usable scenes are appended to the observation table, first written stays.

A late scene of any age is kept, so there is no watermark; each micro-batch is deduplicated in
itself and against the table, which makes a replayed batch harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import observations, scenes
from ..sources.keyed import Rollup


def ingest(stream: DataFrame, table: str, checkpoint: str, once: bool = True, pixels: DataFrame | None = None, months: Rollup | None = None) -> StreamingQuery:
    """``stream``: scenes with an explicit schema, which have area_km2 and cloud_fraction unless ``pixels``
    are given to take them from; ``table``: path of the observations.  Each row says which batch wrote it.  ``months``
    (:func:`features.months` of the table) are brought up to date with each batch."""

    def write(batch: DataFrame, number: int) -> None:
        found = scenes.searched(batch)
        if pixels is not None:
            found = scenes.processed(found, pixels.join(found.select("scene_id").distinct(), "scene_id", "left_semi"))
        observations.append(scenes.first_of_day(found), table, f"stream-{number}")
        if months:
            months.refresh()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
