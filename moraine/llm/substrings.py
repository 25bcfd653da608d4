"""Repeated substrings by a distributed difference-cover algorithm.

A suffix array sorts all suffixes; here only one thing is asked of it, whether a suffix shares its
first ``length`` bytes with a neighbour, so suffixes that can't are discarded on the way:

1. Sample.  A difference cover D modulo V has, for any two positions i and j, a shift d < V with
   both i + d and j + d sampled (position mod V in D).  Two equal strings of ``length`` bytes
   therefore hold an equal string of ``length - V + 1`` bytes at positions sampled in both.
2. Name.  Sampled suffixes get the fingerprint of that many bytes as a name, and the names are
   sorted, each range of names in one task; a name that occurs once is discarded.
3. Recurse on names.  A position stays only if a sampled suffix among the V positions from it on
   has a repeated name: the shift d of step 1 leads to one from each position that matters.
4. Merge and compare.  What remains, sampled or not, is named by its first ``length`` bytes; names
   are sorted again and neighbours compared.

Texts travel packed into blocks; other steps exchange sorted names and bits.  Identical texts are one
class: of a class with two members every byte goes, if there are ``length``.
In step 2 a name has 64 bits, and two strings with one name only leave more positions to step 4.
There a name has 31 more, of a polynomial over a prime field: two different strings agree in these
with odds of ``length`` / 2 ** 31 at most, in the 64 with odds of about 2 ** -64 unless they are built
against it, so among w remaining positions two are taken for equal with odds of about w ** 2 / 2 ** 88.

Scale: ranges hold RANGE_NAMES names each, so their number grows with the input, and so does what a
block sends out for each range.  Beyond some 2 TB a block of BLOCK_BYTES has fewer names than there are
ranges, and a name costs a row of about 80 bytes in the shuffle instead of 8 or 12.  There, raise
both with the executors' memory: 64 MB and 2 ** 23 names need about 1 GB a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, scratch, skew_join, stored
from .shingles import mix, powers, text_bytes

#: A perfect difference set; each difference but 0 occurs once modulo V.
V = 133
COVER = np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])

#: Bytes of a block of texts, unless one text is longer, and positions hashed at once.
BLOCK_BYTES, STEP = 4 << 20, 1 << 20
#: Names that one range of them holds, about.
RANGE_NAMES = 1 << 19

_rng = np.random.default_rng(20240608)
_BYTE, _BYTE2 = (_rng.integers(0, (1 << 64) - 1, 256, dtype=np.uint64, endpoint=True) for _ in range(2))


def _polynomials(data: np.ndarray, at: np.ndarray, length: int, weights: np.ndarray) -> np.ndarray:
    up, down = powers(STEP + 4096)
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(data), STEP):
        lo, hi = np.searchsorted(at, [a, a + STEP])
        if lo < hi:
            part = weights[data[a : a + STEP + length]]
            part *= up[: len(part)]
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
            p = at[lo:hi] - a
            out[lo:hi] = mix((run[p + length] - run[p]) * down[p])
    return out


def fingerprints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the ``length`` bytes from each of the ascending positions ``at`` on."""
    return _polynomials(data, at, length, _BYTE)


#: The field of the second names, and the multiplier in it.
_PRIME = (1 << 31) - 1
_BASE = int(_rng.integers(1 << 20, _PRIME - 1))
_FIELD: list[np.ndarray] = []


def _field(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo _PRIME for i < n."""
    if not _FIELD or len(_FIELD[0]) < n:
        _FIELD.clear()
        for base in (_BASE, pow(_BASE, -1, _PRIME)):
            out = np.ones(n, np.uint64)
            k = 1
            while k < n:  # the first k give the next k
                m = min(k, n - k)
                out[k : k + m] = out[:m] * np.uint64(pow(base, k, _PRIME)) % np.uint64(_PRIME)
                k += m
            _FIELD.append(out)
    return _FIELD[0], _FIELD[1]


def checks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """31 bits more of the same strings: a polynomial over a prime field.  :func:`fingerprints` are
    polynomials modulo 2**64, which for some pairs of strings (a Thue-Morse word and its complement)
    agree whatever the multiplier is."""
    (up, down), prime = _field(STEP + 4096), np.uint64(_PRIME)
    out = np.empty(len(at), np.uint32)
    weights = _BYTE2 % prime
    for a in range(0, len(data), STEP):
        lo, hi = np.searchsorted(at, [a, a + STEP])
        if lo < hi:
            part = weights[data[a : a + STEP + length]]
            part *= up[: len(part)]
            part %= prime
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))  # below 2**53
            p = at[lo:hi] - a
            out[lo:hi] = (run[p + length] - run[p]) % prime * down[p] % prime
    return out


class Block:
    """Texts in a row: which positions are sampled, which remain, and what is covered."""

    def __init__(self, data: bytes, offsets: list[int], length: int):
        self.data, self.offsets, self.length = np.frombuffer(data, np.uint8), np.array(offsets, np.int64), length
        self.short = length - V + 1

    def sampled(self) -> np.ndarray:
        found = []
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            last = b - a - self.short
            if last >= 0:
                p = (np.arange(last // V + 1)[:, None] * V + COVER).ravel()
                found.append(p[p <= last] + a)
        return np.concatenate([*found, np.zeros(0, np.int64)])

    def remaining(self, at: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Positions with ``length`` bytes of their text and a repeated sampled name among the next V."""
        upto = np.zeros(len(self.data) + V + 1, np.int32)
        upto[at[repeated] + 1] = 1
        np.cumsum(upto, out=upto)
        ok = upto[V : V + len(self.data)] > upto[: len(self.data)]
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            ok[max(a, b - self.length + 1) : b] = False
        return np.flatnonzero(ok)

    def spans(self, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the maximal runs of bytes that strings from ``at`` on cover: starts, ends."""
        out = []
        cuts = np.searchsorted(at, self.offsets)
        for k, base in enumerate(self.offsets[:-1].tolist()):
            p = at[cuts[k] : cuts[k + 1]] - base
            first = np.ones(len(p), bool)
            first[1:] = np.diff(p) > self.length
            out.append((p[first], p[np.append(first[1:], True)] + self.length if len(p) else p))
        return out


def _in_order(names: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by name and check, and in it whether each but the first equals the one before."""
    order = np.argsort(names, kind="stable")
    n, c = names[order], check[order]
    same, alike = n[1:] == n[:-1], c[1:] == c[:-1]
    if not alike[same].all():  # names of different strings that are equal
        order = np.lexsort((check, names))
        n, c = names[order], check[order]
        same, alike = n[1:] == n[:-1], c[1:] == c[:-1]
    return order, same & alike


def _names(names: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct names with their checks, whether each occurs again in the block, and the place of
    each position's name."""
    order, same = _in_order(names, check)
    new = np.ones(len(names), bool)
    new[1:] = ~same
    first = np.flatnonzero(new)
    place = np.empty(len(names), np.int64)
    place[order] = np.cumsum(new) - 1
    return names[order[first]], check[order[first]], np.diff(np.append(first, len(names))) > 1, place


def _ranges(distinct: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ranges (the first ``bits`` bits) that sorted names fall in, and their borders."""
    number = (distinct >> np.uint64(64 - bits)).astype(np.int64)
    used, first = np.unique(number, return_index=True)
    return used, np.append(first, len(distinct))


def _asked(blocks: DataFrame, name, bits: int) -> DataFrame:
    """(range, block, names, checks, twice): the sorted names of each block, cut by range.  ``name``
    gives of a block its names and checks (all 0 and not sent if there is one name for all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, names, check, _ = name(row)
                distinct, kept, twice, _ = _names(names, _whole(check, names))
                used, borders = _ranges(distinct, bits)
                cut = list(zip(borders[:-1].tolist(), borders[1:].tolist()))
                out = {
                    "range": pa.array(used, pa.int64()),
                    "block": pa.array([row["block"]] * len(used), pa.int64()),
                    "names": pa.array([distinct[a:b].tobytes() for a, b in cut], pa.binary()),
                    "checks": pa.array([b"" if check is None else kept[a:b].tobytes() for a, b in cut], pa.binary()),
                    "twice": pa.array([np.packbits(twice[a:b]).tobytes() for a, b in cut], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(out)

    # a few ranges of RANGE_NAMES names in a partition, whatever the size of the input
    asked = blocks.mapInArrow(run, "range long, block long, names binary, checks binary, twice binary")
    return asked.repartition(max(4, (1 << bits) // 4), "range")


def _whole(check: np.ndarray | None, names: np.ndarray) -> np.ndarray:
    return np.zeros(len(names), np.uint32) if check is None else check


def _answer(table: pa.Table) -> pa.Table:
    """Of one range: which names of each block occur twice in it or in another block."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("names")]
    every = np.concatenate(parts)
    check = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("checks")])
    order, same = _in_order(every, check if len(check) else _whole(None, every))
    again = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)) for x, p in zip(table.column("twice"), parts)]).astype(bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(x).tobytes() for x in np.split(again, ends[:-1])]
    return pa.table({"block": table.column("block"), "range": table.column("range"), "bits": pa.array(bits, pa.binary())})


def _answers(asked: DataFrame) -> DataFrame:
    """(block, answers), stored: the bits of each block's ranges in order."""
    replies = asked.groupBy("range").applyInArrow(_answer, "block long, range long, bits binary")
    return stored(replies.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("range", "bits"))), lambda x: x["bits"]).alias("answers")), "repeat-answers")


def _answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The bits grow with the texts, so they are never broadcast: blocks meet them by shuffle."""
    return blocks.join(answers.hint("shuffle_hash"), "block", "left")


def _repeated(names: np.ndarray, check: np.ndarray | None, answers: list[bytes] | None, bits: int) -> np.ndarray:
    """For each position's name whether the answers say that it occurs again."""
    distinct, _, _, place = _names(names, _whole(check, names))
    _, borders = _ranges(distinct, bits)
    sizes = np.diff(borders).tolist()
    found = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(answers or [], sizes, strict=True)]
    return np.concatenate([*found, np.zeros(0, np.uint8)]).astype(bool)[place]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of blocks with ``data`` unpacked; ``packed`` is what is stored and moved."""
    for k in range(len(batch)):
        row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
        row["packed"] = row["data"]
        row["data"] = pa.decompress(row["packed"], decompressed_size=row["offsets"][-1], codec="zstd", asbytes=True)
        yield row


def _pack(texts: DataFrame, length: int) -> DataFrame:
    """(block, shas, offsets, data): texts packed in the order in which tasks meet them, then stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, shas, offsets = TaskContext.get().partitionId() << 32, [], [], [0]

        def flush() -> pa.RecordBatch:
            row = [pa.array([block], pa.int64()), pa.array([shas], pa.list_(pa.binary())), pa.array([offsets], pa.list_(pa.int64())), pa.array([pa.compress(b"".join(held), codec="zstd", asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["block", "shas", "offsets", "data"])

        for batch in batches:
            data, starts = text_bytes(batch.column("text"))
            for k, sha in enumerate(batch.column("sha").to_pylist()):
                held.append(data[starts[k] : starts[k + 1]].tobytes())
                shas.append(sha)
                offsets.append(offsets[-1] + len(held[-1]))
                if offsets[-1] >= BLOCK_BYTES:
                    yield flush()
                    block, held, shas, offsets = block + 1, [], [], [0]
        if held:
            yield flush()

    return texts.mapInArrow(run, "block long, shas array<binary>, offsets array<long>, data binary")


def _table(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, sha) of each row and (sha, m, spans, kept_sha256) of each different text, stored."""
    if length < V:
        raise ValueError(f"length must be at least {V}")
    with scratch() as keep:
        text = F.coalesce("text", F.lit(""))
        rows = keep(stored(docs.select(F.col("doc_id").alias("id"), F.octet_length(text).cast("long").alias("n"), _sha(text).alias("sha")), "repeat-rows"))
        classes = stored(rows.groupBy("sha").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("m")), "repeat-classes")

        long_ = classes.filter(F.col("n") >= length)
        copied = broadcast_if_small(stored(long_.filter(F.col("m") > 1).select("sha", "rep"), "repeat-copied"))
        # of a class the rows with its least id are searched, of texts without a copy the only row
        found = docs.select(F.col("doc_id").alias("id"), text.alias("text")).filter(F.octet_length("text") >= length).withColumn("sha", _sha(F.col("text")))
        texts = found.join(copied, "sha", "left").filter(F.col("rep").isNull() | F.col("rep").eqNullSafe(F.col("id"))).select("sha", "text")
        single = _searched(texts, long_.agg(F.sum("n")).first()[0] or 0, length)

        table = classes.join(single, "sha", "left").dropDuplicates(["sha"])
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
        none = F.array().cast("array<struct<start:long,end:long>>")
        copies = (F.col("m") > 1) & (F.col("n") >= length)
        table = table.select(
            "sha",
            "m",
            F.when(copies, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
            F.when(copies, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
        )
        return rows, keep(stored(table, "repeat-table"))


def _sha(text) -> Column:
    return F.unhex(F.sha2(text, 256))


def _searched(texts: DataFrame, total: int, length: int) -> DataFrame:
    """(sha, spans, kept), stored: of (sha, text), ``total`` bytes in all, the repeated spans."""
    blocks = stored(_pack(texts, length), "repeat-blocks")
    bits = lambda names: max(4, int(names // RANGE_NAMES).bit_length())

    def sampled(row: dict) -> tuple[np.ndarray, np.ndarray, None, Block]:
        b = Block(row["data"], row["offsets"], length)
        at = b.sampled()
        return at, fingerprints(b.data, at, b.short), None, b

    first = bits(total * len(COVER) // V)
    answers = _answers(_asked(blocks, sampled, first))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                at, names, check, b = sampled(row)
                rest = b.remaining(at, _repeated(names, check, row["answers"], first))
                # runs of remaining positions: start, length
                starts = rest[np.append(True, np.diff(rest) > 1)] if len(rest) else rest
                ends = rest[np.append(np.diff(rest) > 1, True)] + 1 if len(rest) else rest
                runs = np.stack([starts, ends]).astype(np.int64)
                kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())
                values = (row["block"], row["shas"], row["offsets"], row["packed"], runs.tobytes(), len(rest))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["block", "shas", "offsets", "data", "runs", "left"])

    # the texts are stored again with what remains of them, and the first blocks go
    open_ = stored(_answered(blocks, answers).mapInArrow(narrowed, "block long, shas array<binary>, offsets array<long>, data binary, runs binary, left long"), "repeat-open")
    forget(blocks, answers)
    second = bits(open_.agg(F.sum("left")).first()[0] or 0)

    def remaining(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Block]:
        b = Block(row["data"], row["offsets"], length)
        starts, ends = np.frombuffer(row["runs"], np.int64).reshape(2, -1)
        sizes = ends - starts
        at = np.arange(int(sizes.sum())) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), sizes) if len(sizes) else np.zeros(0, np.int64)
        return at, fingerprints(b.data, at, length), checks(b.data, at, length), b

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for row in _rows(batch):
                at, names, check, b = remaining(row)
                spans, shas = [], []
                for (starts, ends), a, z in zip(b.spans(at[_repeated(names, check, row["answers"], second)]), row["offsets"], row["offsets"][1:]):
                    spans.append([{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist())])
                    sha, last = hashlib.sha256(), 0
                    for x in spans[-1]:
                        sha.update(row["data"][a + last : a + x["start"]])
                        last = x["end"]
                    sha.update(row["data"][a + last : z])
                    shas.append(sha.hexdigest())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_pydict({"sha": pa.array(row["shas"], pa.binary()), "spans": pa.array(spans, kind), "kept": pa.array(shas, pa.string())})

    answers = _answers(_asked(open_, remaining, second))
    done = stored(_answered(open_, answers).mapInArrow(cut, "sha binary, spans array<struct<start:long,end:long>>, kept string"), "repeat-done")
    forget(open_, answers)
    return done


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes), kept_sha256 for each row of ``docs``.

    ``spans`` are the maximal runs of bytes that lie in a string of ``length`` bytes that also starts
    elsewhere, in the same text or another; kept_sha256 (hex) is of the other bytes in a row.
    A null text counts as empty; texts under ``length`` bytes have no spans, rows with equal texts are
    one run each.  An empty table gives no rows.  ``length`` is at least V.
    """
    rows, table = _table(docs, length)
    joined = skew_join(rows, table, "sha", "m", "id")
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), "spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id and the text without its repeated bytes, row by row; characters that were cut through are
    dropped.  A null text is empty."""
    _, table = _table(docs, length)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), _sha(text).alias("sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data, last, kept = text.encode("utf-8"), 0, []
                for x in cuts:
                    kept.append(data[last : x["start"]])
                    last = x["end"]
                texts.append(b"".join([*kept, data[last:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return skew_join(rows, table, "sha", "m", "doc_id").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, text string")
