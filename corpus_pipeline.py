"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; each is written
as Parquet in the shared folder and read again by the next.  All but the last return whole rows of
``documents``, whatever other columns these have, and none drops a row for a null in a column that it
does not look at.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import bpe, exactdup, langid, mixing, neardup
from moraine.llm.common import forget, scratch, ship, stored
from moraine.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by a model fitted to the labels among them.

    Null, empty and letterless texts go, and so do texts that the model's languages explain no better
    than chance, or two of them alike.  A null lang, source or id is no reason to go; repeated rows
    are judged alike; of a long text all is scored.
    """
    ship(spark)
    return langid.known_language(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the least id, or for rows without an id (which come
    after all ids and are not told apart) all of them.  Rows that repeat id and text stay together."""
    return exactdup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, Jaccard 0.8.

    The least id of a component stays.  Texts without words are near to nothing, rows without an id
    stay, several texts under one id are each judged by their own text.
    """
    ship(spark)
    return neardup.near_dedup(docs, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most twice; a null source is a source, rows with one
    id (null too) are taken alike, texts without words as their place says."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of each document that was taken, encoded and decoded; null is empty."""
    ship(spark)
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mixture), ("BPE", tokens)]

#: A fitted model, sketches and BPE can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage.  What a stage stored goes when the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        with scratch() as keep:
            done = keep(stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-")))
        forget(docs)
        docs = done
    return last(spark, docs, sf_dir)
