"""Vector code compression: product codes whose nearest entries come from memoised grid cells.

Vectors are made integers and cut into equal parts; each part position has a codebook of ENTRIES
entries, refined by rounds of k-means.  Space is cut into coarse cells, cubes with a power of two as
side.  For a cell the entries that can be nearest to some point in it are found once, from the least
and greatest distance between its box and each entry, and kept under a hash of the cell; only these
entries are then compared exactly with the points of the cell.

A round is one pass of Spark over the vectors: each task adds up its parts by entry, Spark adds up the
tasks, and the driver gets one row for each entry and component of the codebooks, however many vectors
there are.  The passes read the vectors where they are, so that a lost executor costs a reread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, stored

#: Parts of a vector, entries of a codebook, rounds, integers to a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A codebook's widest side is cut into about so many cells.
CELLS_A_SIDE = 4
#: Cells of each part that a worker remembers; all are forgotten when there are more.
MEMO_CELLS = 1 << 15
#: Integers are held within these bounds (the component's size is 1e15 then).
LARGEST = 1 << 62
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def integers(vectors: pa.Array) -> np.ndarray:
    """(rows, length): floor(SCALE * component) of vectors of one length without nulls, within LARGEST."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        found = np.clip(np.floor(flat * SCALE), -float(LARGEST), float(LARGEST)).astype(np.int64)
    return found.reshape(len(vectors), -1)


def fits(points: np.ndarray, book: np.ndarray, width: int) -> bool:
    """Whether squared distances over ``width`` components stay within 64 bits."""
    most = max([int(np.abs(x).max()) for x in (points, book) if x.size], default=0)
    return 4 * most * most * max(1, width) < LARGEST


class Cells:
    """Nearest entries of one codebook (entries, width); exact, with ties to the lower index."""

    def __init__(self, book: np.ndarray):
        self.book = book
        spread = int((book.max(axis=0) - book.min(axis=0)).max()) if book.size else 0
        self.shift = max(0, (spread // CELLS_A_SIDE).bit_length() - 1)
        self._forget()

    def _forget(self) -> None:
        width = self.book.shape[1]
        self.keys, self.cells, self.near = np.zeros(0, np.uint64), np.zeros((0, width), np.int64), np.zeros((0, len(self.book)), bool)

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """(cells, entries): False where another entry is nearer wherever the point lies in the cell."""
        low = (cells << self.shift)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        least = np.maximum(np.maximum(low - self.book, self.book - high), 0)
        most = np.maximum(np.abs(self.book - low), np.abs(self.book - high))
        return (least * least).sum(axis=2) <= (most * most).sum(axis=2).min(axis=1)[:, None]

    def _masks(self, cells: np.ndarray) -> np.ndarray:
        """Candidates of each row's cell, from the memo; a cell whose hash another one has gets all."""
        keys = np.zeros(len(cells), np.uint64)
        for column in cells.T:
            keys = (keys ^ column.astype(np.uint64)) * _MULTIPLIER
            keys ^= keys >> np.uint64(29)
        some, first, back = np.unique(keys, return_index=True, return_inverse=True)
        new = ~np.isin(some, self.keys)
        if len(self.keys) + int(new.sum()) > MEMO_CELLS:
            self._forget()
            new[:] = True
        if new.any():
            fresh = cells[first[new]]
            merged = np.concatenate([self.keys, some[new]])
            order = np.argsort(merged)
            self.keys = merged[order]
            self.cells = np.concatenate([self.cells, fresh])[order]
            self.near = np.concatenate([self.near, self.candidates(fresh)])[order]
        at = np.searchsorted(self.keys, some)[back]
        return self.near[at] | (self.cells[at] != cells).any(axis=1)[:, None]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each point."""
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not fits(points, self.book, points.shape[1] * PARTS):
            return self._nearest_of_large(points)
        row, entry = np.nonzero(self._masks(points >> self.shift))
        gap = points[row] - self.book[entry]
        distance = (gap * gap).sum(axis=1)
        best = np.minimum.reduceat(distance, np.searchsorted(row, np.arange(len(points))))
        # entries ascend within a row: the first that is as near is the lowest
        equal = np.flatnonzero(distance == best[row])
        return entry[equal[np.unique(row[equal], return_index=True)[1]]], best

    def _nearest_of_large(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in Python's integers."""
        gap = points.astype(object)[:, None, :] - self.book.astype(object)
        distance = (gap * gap).sum(axis=2)
        best = np.array([min(range(len(self.book)), key=row.__getitem__) for row in distance], np.int64)
        return best, distance[np.arange(len(points)), best]


_memo: dict[bytes, list[Cells]] = {}


def _cells_of(books: np.ndarray) -> list[Cells]:
    """One for each part; a worker keeps those of the latest codebooks between its tasks."""
    key = hashlib.sha256(repr(books.shape).encode() + books.tobytes()).digest()
    if key not in _memo:
        _memo.clear()
        _memo[key] = [Cells(book) for book in books]
    return _memo[key]


def kept(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor holds a null, NaN or infinite component."""
    odd = F.exists(F.col(vec_col), lambda x: x.isNull() | ~(F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(F.col(vec_col).isNotNull() & ~F.coalesce(odd, F.lit(False)))


def first_books(vectors: DataFrame) -> np.ndarray | None:
    """(parts, entries, width): the vectors of the least ids, null ids last; None without a vector.  ``vectors``
    (id, v).  Only vectors as long as the first whose length PARTS divides count."""
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    usable = vectors.filter(F.size("v") % PARTS == 0)
    first = usable.orderBy(*order).limit(1).collect()
    if not first:
        return None
    length = len(first[0]["v"])
    rows = usable.filter(F.size("v") == length).orderBy(*order).limit(ENTRIES).collect()
    flat = integers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())))
    return np.ascontiguousarray(flat.reshape(len(rows), PARTS, length // PARTS).transpose(1, 0, 2))


def _sums(books: np.ndarray):
    """The task of a round: (part, entry, component, n, total) of its vectors (v, all of one length)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, (parts, entries, width) = _cells_of(books), books.shape
        totals, counts = np.zeros(books.shape, object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            cut = integers(batch.column("v")).reshape(batch.num_rows, parts, width)
            for p in range(parts):
                index, _ = cells[p].nearest(cut[:, p])
                counts[p] += np.bincount(index, minlength=entries)
                small = fits(cut[:, p], books[p][:0], 1) and batch.num_rows < 1 << 30
                add = np.zeros((entries, width), np.int64 if small else object)
                np.add.at(add, index, cut[:, p].astype(add.dtype))
                totals[p] += add
        used = np.argwhere(np.broadcast_to(counts[:, :, None] > 0, books.shape))
        columns = [pa.array(used[:, i], pa.int32()) for i in range(3)]
        n = pa.array(counts[used[:, 0], used[:, 1]], pa.int64())
        total = pa.array([Decimal(int(totals[tuple(x)])) for x in used], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([*columns, n, total], ["part", "entry", "component", "n", "total"])

    return task


def refined(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` of assigning all parts of ``vectors`` (v) and taking floored means.
    An entry without parts stays."""
    for _ in range(rounds):
        sums = vectors.mapInArrow(_sums(books), "part int, entry int, component int, n long, total decimal(38,0)")
        found = sums.groupBy("part", "entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"], r["component"]] = int(r["total"]) // r["n"]
    return books


def _codes(books: np.ndarray):
    """The last task: id, label, code and error; null where the length is another one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, (parts, _, width) = _cells_of(books), books.shape
        digits = np.array([f"{i:02x}" for i in range(max(ENTRIES, books.shape[1]))], object)
        for batch in batches:
            good = np.flatnonzero(batch.column("fit").to_numpy(zero_copy_only=False))
            cut = integers(batch.column("v").take(pa.array(good))).reshape(len(good), parts, width)
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            code[good], error[good] = "", 0
            for p in range(parts):
                index, distance = cells[p].nearest(cut[:, p])
                code[good] += digits[index]
                error[good] += distance.astype(object)
            error[good] = [min(int(x), (1 << 63) - 1) for x in error[good]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return task


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all integers of the codebooks by part, entry and component, joined by commas."""
    flat = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(id, label, code, error, label_error) of the kept rows, and the final codebooks.

    ``code`` has two hexadecimal digits a part, ``error`` is the squared distance to the entries, and
    ``label_error`` its sum over rows of one label (nulls are one label).  Rows with a null or
    non-finite component are dropped; repeated rows and ids stay, a null id comes after all others.
    A vector of another length than the first has a null code and error and adds nothing; with fewer
    than ENTRIES vectors the codebooks have as many entries.  Errors beyond a long are its largest
    value.  Without vectors there are no rows and no codebooks.  Only the three columns are read.
    """
    rows = kept(vectors, vec_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    books = first_books(rows.select("id", "v"))
    id_type, label_type = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    if books is None:
        none = F.lit(None).cast("long")
        return rows.select("id", "label", none.cast("string").alias("code"), none.alias("error"), none.alias("label_error")), None
    fit = F.size("v") == books.shape[0] * books.shape[2]
    books = refined(rows.filter(fit).select("v"), books)
    found = rows.withColumn("fit", fit).mapInArrow(_codes(books), f"id {id_type}, label {label_type}, code string, error long")
    done = stored(found.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    labels = stored(done.groupBy("key").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n_rows")), "vector-labels")
    return skew_join(done, labels, "key", "n_rows", "id").drop("key", "n_rows"), books
