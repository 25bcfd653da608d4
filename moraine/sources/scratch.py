"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


class Scratch:
    """Tables under ``spark.checkpoint.dir``; on one machine without that setting, as in tests, under a
    temporary folder.  A call writes a table and reads it again: its lineage is cut, so that a lost
    executor costs a reread.  :meth:`close` removes all of them."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            if not _LOCAL:
                _LOCAL.append("file://" + tempfile.mkdtemp(prefix="moraine-"))
            root = _LOCAL[0]
        self.spark, self.path = spark, f"{root.rstrip('/')}/moraine/{name}-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def close(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
