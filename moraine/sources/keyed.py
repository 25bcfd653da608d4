"""Tables with one row a key that several writers may append to at once.

A table is a folder with data and a log.  A writer stages its rows in a data folder of its own, then
claims the next version: a small file in the log that lists the data folders which make up the table.
Only one writer can create the file of a version; whoever comes second takes the keys out of its rows
that were committed meanwhile, and claims the version after.  Readers follow the latest version, so
that they never see a half-written append, and staged rows of a writer that died are not seen at all.
A :class:`Rollup` is a summary of such a table that is kept up by what was appended.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Version:
    """A state of the table: its number, -1 for none yet, and the data folders that make it up."""

    number: int
    folders: tuple[str, ...]


@dataclass(frozen=True)
class Commit:
    """What an append wrote: its version (that of the table if nothing was new), rows, and the rows themselves."""

    version: int
    rows: int
    written: DataFrame


class KeyedTable:
    """The table at ``path`` with the columns of ``schema`` and one row for each value of ``key``.

    ``order`` is the column by which a key's first row is chosen where several come in one append;
    ``pruned`` a key column whose range in the new rows limits what is read of the table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: list[str], order: str | None = None, pruned: str | None = None):
        self.spark, self.path, self.key, self.order, self.pruned = spark, path.rstrip("/"), list(key), order, pruned
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def version(self) -> Version:
        """The latest version."""
        numbers = self._numbers()
        return self._version(numbers[-1]) if numbers else Version(-1, ())

    def _numbers(self) -> list[int]:
        """The numbers of all versions; their names sort by number."""
        fs, log = self._fs(f"{self.path}/log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []
        return [int(n.removesuffix(".json")) for n in names if n.endswith(".json")]

    def _version(self, number: int) -> Version:
        # any file system that Spark reads
        text = self.spark.read.text(f"{self.path}/log/{number:012d}.json", wholetext=True).first()[0]
        return Version(number, tuple(json.loads(text)["folders"]))

    def added(self, since: int, upto: Version) -> tuple[str, ...] | None:
        """The data folders with the rows that came after version ``since``, each row once.  None where some of
        them were compacted and then removed."""
        numbers = [n for n in self._numbers() if since < n < upto.number]
        before = self._version(since).folders if since >= 0 else ()
        # one append later there is nothing between, and no log to walk
        steps = [*(self._version(n) for n in numbers), upto]
        new: list[str] = []
        for step in steps:
            if set(before) <= set(step.folders):
                new += [f for f in step.folders if f not in before]
            # else compacted: its folder holds rows of those that it replaced, which are listed already
            before = step.folders
        fs, _ = self._fs(self.path)
        return tuple(new) if all(fs.exists(self._fs(f"{self.path}/data/{f}")[1]) for f in new) else None

    def _of(self, folders: tuple[str, ...]) -> DataFrame:
        """The rows of some data folders."""
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, by default the latest; none where there is no table yet."""
        return self._of((version or self.version()).folders)

    def _claim(self, number: int, folders: tuple[str, ...]) -> bool:
        """Create the file of a version; False if another writer has it."""
        fs, log = self._fs(f"{self.path}/log")
        fs.mkdirs(log)
        _, staged = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(bytearray(json.dumps({"folders": folders}).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/log/{number:012d}.json")
        try:
            if fs.getScheme() == "file":  # its rename would replace the other writer's file; a link fails
                os.link(urlparse(str(staged.toUri())).path, urlparse(str(final.toUri())).path)
                return True
            return bool(fs.rename(staged, final))  # as in HDFS: fails where the name is taken
        except (FileExistsError, Py4JJavaError):
            if not fs.exists(final):
                raise
            return False
        finally:
            fs.delete(staged, False)

    def _first_of_key(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.schema.names if c not in self.key]
        by = [self.order, *(c for c in rest if c != self.order)] if self.order else rest
        return rows.groupBy(*self.key).agg(F.min(F.struct(*by)).alias("_first")).select(*self.key, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(*self.schema.names)

    def _near(self, rows: DataFrame, there: DataFrame) -> DataFrame:
        """``there`` as far as it can hold keys of ``rows``: a range that reaches the files."""
        if not self.pruned:
            return there
        first, last = rows.agg(F.min(self.pruned), F.max(self.pruned)).first()
        at = F.col(self.pruned)
        return there.filter(at.isNull() if first is None else at.between(F.lit(first), F.lit(last)) | at.isNull())

    def _stage(self, rows: DataFrame) -> tuple[str, int]:
        """Write rows to a new data folder; its name, and their number as the write itself counted it."""
        folder, seen = uuid.uuid4().hex, Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/data/{folder}")
        return folder, seen.get["n"]

    def _remove(self, folder: str) -> None:
        fs, at = self._fs(f"{self.path}/data/{folder}")
        fs.delete(at, True)

    def append(self, rows: DataFrame) -> Commit:
        """Append the rows whose key is not there yet.  A missing column of the schema is null, others are
        left out; of a key that comes twice the first by ``order`` counts; null keys are keys like others."""
        ready = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])
        known = self.version()
        folder, n = self._stage(self._first_of_key(ready))  # what makes the rows runs once
        fresh = known.folders
        while True:
            if fresh:
                again, n = self._stage(self._without(self._of((folder,)), self._of(fresh)))
                self._remove(folder)
                folder = again
            if not n:
                self._remove(folder)
                return Commit(known.number, 0, self._of(()))
            if self._claim(known.number + 1, (*known.folders, folder)):
                return Commit(known.number + 1, n, self._of((folder,)))
            # someone was faster: what they committed is checked, not the whole table again
            now = self.version()
            fresh, known = tuple(f for f in now.folders if f not in known.folders), now

    def _without(self, rows: DataFrame, there: DataFrame) -> DataFrame:
        near = self._near(rows, there).select(*(F.col(k).alias(f"_{k}") for k in self.key))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.key]
        condition = same[0]
        for x in same[1:]:
            condition = condition & x
        return rows.join(near, condition, "left_anti")

    def compact(self, partitions: int = 1) -> Version:
        """Rewrite the data folders as one; appends that run meanwhile are kept.  Old folders stay for readers
        that follow an older version, until :meth:`vacuum`."""
        known = self.version()
        if len(known.folders) < 2:
            return known
        folder, _ = self._stage(self.read(known).repartition(partitions, *self.key))
        while True:
            now = self.version()
            if not set(known.folders) <= set(now.folders):  # another one compacted
                self._remove(folder)
                return now
            later = tuple(f for f in now.folders if f not in known.folders)
            if self._claim(now.number + 1, (folder, *later)):
                return Version(now.number + 1, (folder, *later))

    def vacuum(self) -> int:
        """Remove data folders that the latest version does not list; for when no reader or writer is at work."""
        fs, data = self._fs(f"{self.path}/data")
        listed = set(self.version().folders)
        old = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in listed] if fs.exists(data) else []
        for at in old:
            fs.delete(at, True)
        return len(old)


class Rollup:
    """The rows of ``fold`` over all rows of ``source``, at ``path``.

    ``fold`` gives partial rows of any part of the source and ``merge`` makes one of the partial rows of
    several parts, so that the parts may be cut anywhere.  A version of the rollup has the number of the
    version of the source that it holds, and lists the parts that make it up: a refresh that dies leaves
    nothing behind, one that runs twice folds no row twice, and of two at once either may come first.
    """

    def __init__(self, source: KeyedTable, path: str, schema: StructType | str, fold: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], parts: int = 16):
        self.source, self.fold, self.merge, self.parts = source, fold, merge, parts
        self.table = KeyedTable(source.spark, path, schema, [])

    def refresh(self) -> Version:
        """Fold what the source has got since; rows that are known are not read again.  More than ``parts``
        parts are merged into one."""
        known, now = self.table.version(), self.source.version()
        if now.number <= known.number:
            return known
        folders = self.source.added(known.number, now)
        if folders is None:  # the source has thrown away what was not folded yet
            known, folders = Version(-1, ()), now.folders
        kept = known.folders
        if folders:
            rows = self.fold(self.source._of(folders))
            if len(kept) >= self.parts:
                rows, kept = self.merge(self.table._of(kept).unionByName(rows)), ()
            kept = (*kept, self.table._stage(rows)[0])
        if not self.table._claim(now.number, kept) and folders:
            self.table._remove(kept[-1])  # another refresh folded the same rows
        return self.table.version()

    def read(self) -> DataFrame:
        """The rows as of the last refresh."""
        return self.merge(self.table.read())
