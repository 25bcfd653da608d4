"""Token ids in files: fixed-width bit packing with block offsets.

A file is a Parquet table of segments, written by Spark's committer (so a lost task leaves nothing
behind), each one binary value of some MB at most (or one document):

    magic "MTK1", bits u8, 3 bytes 0, n_docs u32, ids per block u32, n_ids u64,
    null flags u8[n_docs], padded to 8; doc ids i64[n_docs]; document starts u64[n_docs + 1];
    block offsets u64[n_blocks + 1]; packed ids

Ids take ``bits`` bits each, the least that holds the vocabulary, lowest bit first.  A block of 4096
ids is a whole number of bytes, so any range of ids is unpacked from its blocks alone.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, byte_symbols
from .common import broadcast_if_small, cleaned, forget, new_path, stored

MAGIC, PER_BLOCK = b"MTK1", 4096
#: Ids of a segment, unless one document has more.
SEGMENT = 1 << 18
#: Text of a shard: the least, and the most, which a table of more than SHARDS of the least has; its
#: task sorts on disk and holds one segment, so the most costs time alone.
SHARD_BYTES, MOST_BYTES, SHARDS = 4 << 20, 1 << 30, 4096
#: Rows of an id are dealt apart by a hash of the text below this.
TIES = 1 << 20
#: Bytes of a worker's memo: the library takes 8 microseconds for a word that the memo lacks.
MEMO_BYTES = 192 << 20
HEAD = struct.Struct("<4sB3xIIQ")


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    rows = np.zeros((n, 32), dtype=np.uint8)
    rows[:, :bits] = flat
    return np.packbits(rows, axis=1, bitorder="little").view("<u4").ravel()


def write_segment(doc_ids: list[int | None], docs: list[np.ndarray], bits: int) -> bytes:
    ids = np.concatenate([*docs, np.zeros(0, "<u4")])
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs], dtype=np.uint64))).astype("<u8")
    blocks = [pack_bits(ids[i : i + PER_BLOCK], bits) for i in range(0, len(ids), PER_BLOCK)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.uint64))).astype("<u8")
    nulls = bytes(i is None for i in doc_ids)
    nulls += b"\0" * (-len(nulls) % 8)
    keys = np.array([0 if i is None else i for i in doc_ids], dtype="<i8")
    return b"".join([HEAD.pack(MAGIC, bits, len(docs), PER_BLOCK, len(ids)), nulls, keys.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """Reads a segment; ``ids(a, b)`` touches only the blocks that hold ids a to b."""

    def __init__(self, data: bytes | memoryview):
        magic, self.bits, self.n_docs, self.per_block, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size
        nulls = bytes(data[at : at + self.n_docs])
        at += self.n_docs + -self.n_docs % 8
        keys = np.frombuffer(data, "<i8", self.n_docs, at).tolist()
        self.doc_ids = [None if null else k for k, null in zip(keys, nulls)]
        at += 8 * self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        n_blocks = -(-self.n_ids // self.per_block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, "<u4")
        first, last = a // self.per_block, -(-b // self.per_block)
        n = min(self.n_ids, last * self.per_block) - first * self.per_block
        found = unpack_bits(self.body[self.offsets[first] : self.offsets[last]], n, self.bits)
        return found[a - first * self.per_block : b - first * self.per_block]

    def doc(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


@lru_cache(maxsize=2)
def library_encoder(path: str) -> Encoder:
    """The tokenizers library behind a memo of the pieces it has encoded; one for each worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    model, symbols = t.model, dict(enumerate(byte_symbols()))
    specials = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
    dtype = "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"

    def encode(pieces: list[str]) -> Iterator[list[int]]:
        # the pieces are split already: the library's model takes them in its byte symbols
        for p in pieces:
            yield [x.id for x in model.tokenize(p.encode("utf-8").decode("latin-1").translate(symbols))]

    return Encoder(encode, specials, dtype, lambda text: [t.encode(text, add_special_tokens=False).ids], MEMO_BYTES)


def vocabulary_bits(path: str) -> int:
    from tokenizers import Tokenizer

    return max(1, (Tokenizer.from_file(path).get_vocab_size() - 1).bit_length())


def _key() -> tuple[Column, Column]:
    return F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("text"), F.lit(TIES)).cast("long").alias("tie")


def shard_borders(docs: DataFrame) -> list[tuple[int | None, int]]:
    """The first (doc_id, tie) of each shard but the first, in order: shards of about equal bytes.

    Bytes are added up along the order by id: within ranges of ids, each in one task, and over the
    ranges.  There is one border for MOST_BYTES of text, or SHARDS of them, whichever is more.
    """
    keys = stored(docs.select(*_key(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")), "token-keys")
    size = keys.agg(F.sum("n")).first()[0] or 0
    each = max(SHARD_BYTES, min(MOST_BYTES, -(-size // SHARDS)))
    if size <= each:
        forget(keys)
        return []
    order = (F.col("doc_id").asc_nulls_first(), F.col("tie"))
    ranged = stored(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "token-ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(bases), "part")
    shard = F.floor((F.col("base") + F.col("inside")) / each)
    first = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("f"))
    with cleaned(docs.sparkSession):
        found = first.filter("shard > 0").orderBy("shard").select("f.doc_id", "f.tie").collect()
    forget(keys, ranged)
    return [(r["doc_id"], r["tie"]) for r in found]


def _binary(column: pa.Array) -> Iterator[memoryview]:
    """The values of a binary column, in the memory of the batch."""
    for x in column:
        yield memoryview(x.as_buffer())


def encoded(docs: DataFrame, path: str, borders: list[tuple[int | None, int]], end_id: int = 0) -> DataFrame:
    """shard, doc_id, tie, n, ids (binary, 2 or 4 bytes an id): the library's ids and ``end_id``."""
    known = lambda i, tie: (i is not None, i or 0, tie)
    cuts = [known(*b) for b in borders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        end = encoder.pack([end_id])
        for batch in batches:
            packed = [b"".join(encoder.encode(x.as_py())) + end for x in batch.column("text")]
            n = pa.array([len(p) // len(end) for p in packed], pa.int64())
            shard = [bisect_right(cuts, known(i, t)) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist())]
            out = {"shard": pa.array(shard, pa.int32()), "doc_id": batch.column("doc_id"), "tie": batch.column("tie"), "n": n, "ids": pa.array(packed, pa.binary())}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(*_key(), "text").mapInArrow(run, "shard int, doc_id long, tie long, n long, ids binary")


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int = 0) -> DataFrame:
    """Write the ids of ``docs`` to ``out`` in ascending doc_id order; return (shard, base), base being
    the ids of all shards before it.

    Each row of ``out`` is a segment: shard, segment, n_docs, n_ids, inside (ids of the shard before
    it), data.  Nulls come first; rows that repeat an id follow each other, ordered by a hash of the
    text, length and content.  An empty table gives no segments.
    """
    bits = vocabulary_bits(path)
    borders = shard_borders(docs)
    rows = encoded(docs, path, borders, end_id)
    dealt = rows.repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie", "n", F.xxhash64("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, inside, size = -1, 0, 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            row = {"shard": [shard], "segment": [segment], "n_docs": [len(keys)], "n_ids": [size], "inside": [inside], "data": [write_segment(keys, held, bits)]}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(row.items(), kinds)})

        for batch in batches:
            for at, key, n, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n")), _binary(batch.column("ids"))):
                if held and (size + n > SEGMENT or at != shard):
                    yield flush()
                    inside, segment, keys, held, size = inside + size, segment + 1, [], [], 0
                if at != shard:
                    shard, segment, inside = at, 0, 0
                keys.append(key)
                held.append(np.frombuffer(bytes(ids), dtype=f"<u{len(ids) // n}"))
                size += n
        if held:
            yield flush()

    with cleaned(docs.sparkSession):
        dealt.mapInArrow(run, "shard int, segment int, n_docs long, n_ids long, inside long, data binary").write.option("compression", "none").parquet(out)
    shards = docs.sparkSession.read.parquet(out).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row a shard of millions of ids goes through one task
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return stored(shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "token-bases")


def read_tokens(spark, out: str, bases: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, data in zip(batch.column("before").to_pylist(), _binary(batch.column("data"))):
                s = Segment(data)
                every, ends = s.ids(0, s.n_ids), s.starts.tolist()
                crc = [zlib.crc32(every[a:b]) for a, b in zip(ends, ends[1:])]
                out = {"doc_id": pa.array(s.doc_ids, pa.int64()), "start": pa.array(s.starts[:-1] + before), "n_tokens": pa.array(np.diff(s.starts)), "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.RecordBatch.from_pydict(out)

    files = spark.read.parquet(out).join(broadcast_if_small(bases), "shard")
    return files.select((F.col("base") + F.col("inside")).alias("before"), "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ranges(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and read them back."""
    out = new_path(docs.sparkSession, "token-files")
    return read_tokens(docs.sparkSession, out, write_tokens(docs, path, out, end_id))
