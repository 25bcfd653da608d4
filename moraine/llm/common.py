"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space (a word is any run of other characters) that are not one space.
NOT_ONE_SPACE = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"

_LOCAL_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder: ``spark.checkpoint.dir``.

    Where the setting is missing on one machine (tests) a temporary folder is made once; on a
    cluster that is an error, since no folder of the driver is seen by the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="moraine-"))
    return _LOCAL_DIR[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/moraine/{name}-{uuid.uuid4().hex}"


def made(spark: SparkSession, name: str) -> list[str]:
    """Paths of the tables of that name in the shared folder that were written to their end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/moraine/{name}-*/_SUCCESS")
    found = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at)
    return sorted(x.getPath().getParent().toString() for x in found or [])


#: Removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


_scopes = threading.local()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and what follows
    plans with the true size of the table.  The shuffles that made it are removed at once, the table
    at the end of the ``scratch`` it was made in, else by ``forget``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if getattr(_scopes, "open", None) is not None:
        _scopes.open.append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stored tables made inside are removed at the end, but for those passed to the function that this
    gives: what a result that has not been computed yet reads."""
    outer, mine, kept = getattr(_scopes, "open", None), [], []
    _scopes.open = mine

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scopes.open = outer
        forget(*(t for t in mine if not any(t is k for k in kept)))
        if outer is not None:
            outer.extend(kept)


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again: later stored tables hold what they were for."""
    for df in tables:
        path, df._stored_at = getattr(df, "_stored_at", None), None
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value``, which is computed once a row.

    Inside a lambda a column expression would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), NOT_ONE_SPACE, " ")


def words_of(text: Column) -> Column:
    """Words of a text, in order; none for null.  A split at a single character needs no regex."""
    return F.array_remove(F.split(normalised(text), " "), "")


#: Rows of (id) or (key) that may be broadcast: a hash relation of these takes under 100 MB.
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a stored, narrow table for broadcast if it has ``limit`` rows at most; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, digest: Column, id_col: str = "doc_id") -> DataFrame:
    """``docs`` but for the rows with an (id, digest) of ``dropped`` (a stored table with columns id and
    digest; an id may be null).  ``digest``: of a row of ``docs``; the rows of one id may differ in it."""
    mine, gone_id, gone = (free_name(docs, x) for x in ("_digest", "_gone_id", "_gone"))
    keyed = docs.withColumn(mine, digest)
    gone_rows = broadcast_if_small(dropped).select(F.col("id").alias(gone_id), F.col("digest").alias(gone))
    return keyed.join(gone_rows, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(mine) == F.col(gone)), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


#: Bytes of an Arrow batch between the JVM and Python: both sides hold a few copies of one for each core.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make the session ready for operators in Python.

    Arrow batches are held to ARROW_BYTES, unless the session has a lower bound already.  This package
    goes to the executors' Python, unless PYTHONPATH has it.
    """
    found = spark.conf.get(_ARROW).strip().lower()
    if not re.fullmatch(r"[0-9]+b?", found) or int(found.rstrip("b")) > ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_moraine_shipped", False):
        return
    name = Path(tempfile.mkdtemp(prefix="moraine-")) / "moraine.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "moraine").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(name))
    spark.sparkContext._moraine_shipped = True


#: Keys with more than one in so many of all rows are hot; there are fewer than this many.
HOT_SHARE = 1024


def skew_join(rows: DataFrame, table: DataFrame, key: str, count: str, id_col: str) -> DataFrame:
    """Left join of ``rows`` with ``table`` (stored; one row a key, ``count`` = its rows in ``rows``).

    Hot keys, fewer than HOT_SHARE, are matched by broadcast, and their rows then dealt by id; so are
    rows whose key is null, which match nothing.
    """
    hot_rows = max(1, (table.agg(F.sum(count)).first()[0] or 0) // HOT_SHARE)
    rest = [c for c in table.columns if c != key]
    hot = table.filter(F.col(count) > hot_rows).select(F.col(key), F.struct(*rest).alias("_hot"))
    cold = table.filter(F.col(count) <= hot_rows).select(F.col(key).alias("_key"), F.struct(*rest).alias("_cold"))
    own = F.concat(F.lit("id "), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast(table.schema[key].dataType)
    met = rows.join(F.broadcast(hot), key, "left").withColumn("_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(own))
    met = met.join(cold, "_key", "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return met.select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in rest))
