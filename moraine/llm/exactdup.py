"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then of all.

Texts count as equal when they are identical after each run of ASCII white space has become one
space.  A document whose length nobody shares is settled by its length alone, one whose prefix
nobody of that length shares by its prefix; only what survives both is hashed in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, normalised, scratch, skew_join, stored, without

PREFIX = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id_col, keep_id, group_size (long), kept, text_sha256.

    Null counts as the empty text.  The row with the smallest id of a group stays; rows that repeat
    both id and text are the same document and stay together (each counts in group_size).
    Rows with a null id come after all ids: of a group of null ids alone all rows stay, since nothing
    tells them apart.  text_sha256 (hex, of the normalised text in UTF-8) is null for texts that refinement settled
    before the full hash, unless ``hash_all``.  Other columns of ``docs`` are not looked at; an
    empty table gives an empty one.
    """
    with scratch() as hold:
        norm = F.col("norm")
        keyed = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).select(
            "id", F.length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix"), "norm"
        )
        profile = stored(keyed.select("id", "len", "prefix"), "exact-profile")

        # lengths that at least two rows share, then the (length, prefix) that two of those share
        shared = lambda df, *key: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
        pairs = shared(profile, "len", "prefix").join(shared(profile, "len"), "len", "left_semi")
        pairs = stored(pairs.withColumn("open", F.lit(True)), "exact-pairs")

        key, sha = ["len", "prefix"], F.sha2(norm, 256)
        small = broadcast_if_small(pairs)
        if small is not pairs:
            # the list meets the texts where they are read, and only open ones are hashed
            joined = keyed.join(small, key, "left")
            full = sha if hash_all else F.when(F.col("open"), sha)
            hashed = joined.select("id", "open", full.alias("full"))
        else:
            # so long a list prunes little: hash while reading, and move the hash instead of the text
            hashed = keyed.select("id", *key, sha.alias("full")).join(pairs, key, "left")
            hashed = hashed.select("id", "open", F.col("full") if hash_all else F.when(F.col("open"), F.col("full")).alias("full"))
        hashed = hold(stored(hashed.select("id", F.coalesce("open", F.lit(False)).alias("open"), "full"), "exact-full"))

        groups = hashed.filter("open").groupBy("full").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        groups = hold(stored(groups, "exact-groups"))
    keep = F.coalesce("keep_id", "id")
    return skew_join(hashed, groups, "full", "n", "id").select(
        F.col("id").alias(id_col),
        F.when(F.col("open"), keep).otherwise(F.col("id")).alias("keep_id"),
        F.when(F.col("open") & F.col("n").isNotNull(), F.col("n")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        (~F.col("open") | keep.eqNullSafe(F.col("id"))).alias("kept"),
        F.col("full").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, that ``exact_groups`` keeps: no row with a smaller doc_id has their
    text, and for rows without an id, no row with one has it.  Null counts as the empty text, rows
    that repeat both id and text stay together, and so do equal texts that only rows without an id
    have; other columns may have any name."""
    with scratch() as hold:
        dropped = exact_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
        dropped = hold(stored(dropped.distinct(), "exact-dropped"))
    return without(docs, dropped, F.sha2(normalised(F.col("text")), 256))
