"""Prefix trie of conversations: a node table under a minimal perfect hash, shard by shard.

A prefix of d turns is named by two 64-bit digests, each the exclusive or of a hash of every turn with
its place; a third one, of other hashes, is verified to be one for each name.  Conversations are cut
into blocks by a range partition over (conversation, turn), and running values go from block to block
by a small table of block totals, so that no conversation, however long, is one task's.

Spark counts the members of each distinct prefix.  Nodes with few turns below them belong to shards of
whole subtrees: a shard assigns its digests to slots 0 .. n - 1 by a minimal perfect hash, verifies
each slot against the digest stored in it, and adds up flat arrays through the array of parent slots
from the deepest nodes on.  The few nodes above the shards get the shards' sums and are added up the
same way, or by depth in Spark where there are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, scratch, ship, stored, words_of

#: Conversations are rebuilt on the one with the next lower multiple of FAMILY; of it they
#: take up to MAX_HEAD turns.
FAMILY, MAX_HEAD = 20, 3
#: Turns below the top of a shard, at most: a share of all, within bounds.
SHARD_SHARE, LEAST_SHARD, MOST_SHARD = 256, 1 << 12, 1 << 20
#: Nodes above the shards that one task adds up, at most.
MAX_ABOVE = 1 << 20
#: Bytes of ids in one piece of a node's list of ends.
PIECE = 1 << 16

_ORDER = ["turn", "role", "m1", "m2"]


def head(conv: Column) -> Column:
    """How many turns a conversation takes from its family's first one."""
    return F.crc32(conv.cast("string").cast("binary")) % (MAX_HEAD + 1)


def _number(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("long")


def _turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, m1, m2, words): digests in place of texts."""
    text, role = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("text", "role"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), digest.alias("digest"), F.size(words_of(text)).cast("long").alias("words")
    )
    return rows.select("c", "turn", "role", _number(F.col("digest"), 1).alias("m1"), _number(F.col("digest"), 16).alias("m2"), "words")


def _before(value: Column) -> Column:
    """``value``, a sum or exclusive or, of a conversation's blocks before this one; 0 for the first."""
    w = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(value.over(w), F.lit(0).cast("long"))


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, block, d, length, m1, m2, words), d from 1, and (c, length) of every conversation."""
    cut = stored(_turns(conversations).repartitionByRange("c", *_ORDER).withColumn("block", F.spark_partition_id()), "trie-turns")
    blocks = cut.groupBy("c", "block").agg(F.count(F.lit(1)).alias("n"))
    own = blocks.groupBy("c").agg(F.sum("n").alias("n_own"))
    base = own.select(F.col("c").alias("base"), F.col("n_own").alias("n_base"))
    lengths = own.withColumn("base", F.col("c") - F.col("c") % FAMILY).withColumn("h", head(F.col("c"))).join(base, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    lengths = stored(lengths.select("c", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length")), "trie-lengths")
    at = blocks.withColumn("before", _before(F.sum("n"))).drop("n").join(lengths.drop("base"), "c")
    local = F.row_number().over(Window.partitionBy("c", "block").orderBy(*_ORDER))
    placed = cut.join(at, ["c", "block"]).withColumn("place", F.col("before") + local - 1)
    placed = stored(placed.select("c", "block", "place", "h", "taken", "length", "m1", "m2", "words"), "trie-placed")
    mine = placed.filter("place >= h").select("c", "block", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("d"), "length", "m1", "m2", "words")
    first = placed.filter((F.col("place") < MAX_HEAD) & (F.col("c") % FAMILY == 0)).select(F.col("c").alias("base"), "place", "m1", "m2", "words")
    heads = lengths.join(first, "base").filter("place < h").select("c", F.lit(-1).alias("block"), (F.col("place") + 1).alias("d"), "length", "m1", "m2", "words")
    return mine.unionByName(heads), lengths.select("c", "length")


def _steps(turns: DataFrame) -> DataFrame:
    """(c, d, length, a, b, check, pa, pb, words): each prefix of at least one turn, by digests, and its parent."""
    hashed = {"a": F.xxhash64(F.lit(1), "d", "m1", "m2"), "b": F.xxhash64(F.lit(2), "m2", "d", "m1"), "check": F.xxhash64(F.lit(3), "m1", "m2", "d")}
    rows = stored(turns.withColumns(hashed).drop("m1", "m2"), "trie-rebuilt")
    blocks = rows.groupBy("c", "block").agg(*[F.bit_xor(x).alias(x) for x in hashed])
    at = blocks.select("c", "block", *[_before(F.bit_xor(x)).alias(f"{x}_before") for x in hashed])
    w = Window.partitionBy("c", "block").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(at, ["c", "block"]).withColumns({f"{x}_run": F.bit_xor(x).over(w).bitwiseXOR(F.col(f"{x}_before")) for x in hashed})
    return found.select(
        "c", "d", "length", *[F.col(f"{x}_run").alias(x) for x in hashed], F.col("a_run").bitwiseXOR(F.col("a")).alias("pa"), F.col("b_run").bitwiseXOR(F.col("b")).alias("pb"), "words"
    )


class Slots:
    """A minimal perfect hash of distinct keys (pairs of 64 bits): level by level, keys alone in their place
    take the next slots, the others go on.  A key that was not among them gets any slot or -1."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[np.ndarray] = []
        rest, used = np.arange(len(a)), 0
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("equal digests in a shard")
            place = self._place(a[rest], b[rest], len(self.levels), size := len(rest) * 3 // 2 + 1)
            alone = np.bincount(place, minlength=size) == 1
            slots = np.full(size, -1, np.int64)
            slots[alone] = np.arange(used, used := used + int(alone.sum()))
            self.levels.append(slots)
            rest = rest[~alone[place]]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (a.astype(np.uint64) ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31)) ^ b.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(30))) % np.uint64(size)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, slots in enumerate(self.levels):
            found = slots[self._place(a[rest], b[rest], level, len(slots))]
            out[rest] = found
            rest = rest[found < 0]
        return out


_NODE = "a long, b long, pa long, pb long, d long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long"


def accumulate(nodes: pa.Table) -> pa.Table:
    """Of a shard (a, b, pa, pb, d, conv_id, n_convs, words, and what is known of children outside it): the
    columns of _NODE.  parent_conv_id is null where the parent is outside."""
    column = {x: nodes.column(x).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for x in nodes.column_names if x != "shard"}
    hashed = Slots(column["a"], column["b"])
    slot = hashed(column["a"], column["b"])
    flat = {}
    for x, values in column.items():
        flat[x] = np.empty(len(values), np.int64)
        flat[x][slot] = values
    if not ((flat["a"][slot] == column["a"]) & (flat["b"][slot] == column["b"])).all():
        raise ValueError("two digests in one slot")
    parent = hashed(flat["pa"], flat["pb"])
    # the root is its own parent by digest
    inside = (parent >= 0) & (flat["a"][parent] == flat["pa"]) & (flat["b"][parent] == flat["pb"]) & (flat["d"] > 0)
    parent[~inside] = -1
    children = flat["n_children"]
    np.add.at(children, parent[inside], 1)
    leaves = flat["n_leaves"] + (children == 0)
    saved = flat["saved_tokens"] + (flat["n_convs"] - 1) * flat["words"]
    deepest = np.flatnonzero(inside)
    deepest = deepest[np.argsort(-flat["d"][deepest], kind="stable")]
    for some in np.split(deepest, np.flatnonzero(np.diff(flat["d"][deepest])) + 1):
        np.add.at(leaves, parent[some], leaves[some])
        np.add.at(saved, parent[some], saved[some])
    of = pa.array(flat["conv_id"][parent], mask=~inside) if len(parent) else pa.array([], pa.int64())
    names = ["a", "b", "pa", "pb", "d", "conv_id", "n_convs"]
    return pa.table([*(pa.array(flat[x]) for x in names), pa.array(children), pa.array(leaves), pa.array(saved), of], [*names, "n_children", "n_leaves", "saved_tokens", "parent_conv_id"])


def _above_by_depth(above: DataFrame) -> DataFrame:
    """The columns of _NODE for ``above``, level by level from the deepest: one job a level."""
    deepest, done = above.agg(F.max("d")).first()[0], []
    for d in range(deepest, -1, -1):
        mine = above.filter(F.col("d") == d)
        if done:
            sums = done[-1].groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            mine = mine.join(sums, ["a", "b"], "left").fillna(0, ["n", "l", "s"])
            mine = mine.withColumns({"n_children": F.col("n_children") + F.col("n"), "n_leaves": F.col("n_leaves") + F.col("l"), "saved_tokens": F.col("saved_tokens") + F.col("s")})
        mine = mine.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
        done.append(stored(mine.select("a", "b", "pa", "pb", "d", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), "trie-level"))
    out = done[0]
    for level in done[1:]:
        out = out.unionByName(level)
    return out.withColumn("parent_conv_id", F.lit(None).cast("long"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, c) as texts of ids joined by commas: (a, b, first, text), of about PIECE bytes."""
    for batch in batches:
        a, b, c = (batch.column(x).to_numpy() for x in ("a", "b", "c"))
        if not len(a):
            continue
        step = PIECE // 16
        starts = np.union1d(np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))), np.arange(0, len(a), step))
        ids, ends = c.tolist(), [*starts[1:], len(a)]
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(c[starts]), pa.array([",".join(map(str, ids[i:j])) for i, j in zip(starts, ends)], pa.string())], ["a", "b", "first", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ends_sha256) of pieces sorted by (a, b, first); one state of the hash at a time."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())], ["a", "b", "ends_sha256"])

    done: list[tuple[tuple[int, int], str]] = []
    for batch in batches:
        for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").to_pylist()):
            if (a, b) == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                done.append((key, state.hexdigest()))
            key, state = (a, b), hashlib.sha256(text.encode())
            if len(done) >= 4096:
                yield row()
                done.clear()
    if key is not None:
        done.append((key, state.hexdigest()))
    yield row()


def _ends(rows: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, c), the conversations that end at a node.  Ids are joined where a range
    partition has them; what one task then hashes of a node's pieces is a stream of its ids' digits,
    since SHA-256 has no other order."""
    pieces = rows.repartitionByRange("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(_pieces, "a long, b long, first long, text string")
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """One row for each distinct prefix of the rebuilt ``conversations`` (conv_id, turn, role, text).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.  Null turns come first; equal turns are ordered by role, then by a digest of the text;
    repeated rows are turns of their own.  Null roles and texts are empty; rows without a conv_id belong
    to no conversation.  An empty table gives no rows, not even the root.  Other columns are not read.
    ``shard_turns`` is the greatest number of turns below the top of a shard.
    """
    ship(conversations.sparkSession)
    with scratch() as keep:
        turns, lengths = _rebuilt(conversations)
        steps = stored(_steps(turns), "trie-steps")
        zero = F.lit(0).cast("long")
        root = lengths.select("c", zero.alias("d"), "length", *[zero.alias(x) for x in ("a", "b", "check", "pa", "pb", "words")])
        every = steps.unionByName(root)
        one = F.when(F.min("check") == F.max("check"), F.min("c")).otherwise(F.raise_error(F.lit("two prefixes of one digest")).cast("long"))
        nodes = every.groupBy("a", "b", "d").agg(
            one.alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.sum(F.col("length") - F.col("d") + 1).alias("weight")
        )
        nodes = stored(nodes, "trie-nodes")
        total = nodes.filter("d = 0").agg(F.max("weight")).first()[0] or 0
        limit = shard_turns or max(LEAST_SHARD, min(MOST_SHARD, total // SHARD_SHARE))
        is_above = (F.col("weight") > limit) | (F.col("d") == 0)
        above = stored(nodes.filter(is_above).drop("weight"), "trie-above")
        # the top of a conversation's shard: its first node that is not above
        marked = steps.select("c", "d", "a", "b").join(broadcast_if_small(above.select("a", "b", F.lit(True).alias("above"))), ["a", "b"], "left")
        tops = marked.filter("above is null").groupBy("c").agg(F.min(F.struct("d", "a", "b")).alias("top")).select(F.col("c").alias("conv_id"), F.xxhash64("top.a", "top.b").alias("top"))
        n_shards = max(1, -(-total // limit))
        none = {x: zero for x in ("n_children", "n_leaves", "saved_tokens")}
        below = nodes.filter(~is_above).drop("weight").join(tops, "conv_id").withColumn("shard", F.pmod("top", F.lit(n_shards))).drop("top").withColumns(none)
        below = keep(stored(below.groupBy("shard").applyInArrow(accumulate, _NODE), "trie-below"))
        sums = below.filter("parent_conv_id is null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
        )
        above = above.join(sums, ["a", "b"], "left").fillna(0, list(none))
        few = nodes.filter(is_above).limit(MAX_ABOVE + 1).count() <= MAX_ABOVE
        summed = above.withColumn("shard", F.lit(0)).groupBy("shard").applyInArrow(accumulate, _NODE) if few else _above_by_depth(stored(above, "trie-above"))
        summed = keep(stored(summed, "trie-summed"))
        ends = keep(stored(_ends(every.filter("d = length").select("a", "b", "c")), "trie-ends"))
    parents = broadcast_if_small(summed.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above_id")))
    inside, outside = below.filter("parent_conv_id is not null"), below.filter("parent_conv_id is null").unionByName(summed)
    found = outside.join(parents, ["pa", "pb"], "left").withColumn("parent_conv_id", F.when(F.col("d") > 0, F.coalesce("parent_conv_id", "above_id"))).drop("above_id").select(*inside.columns)
    found = inside.unionByName(found).join(ends, ["a", "b"], "left")
    return found.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
