"""Mixing sources to target weights by hash thresholds.

Each document has a place in [0, 2**60): the first 60 bits of the MD5 of its id.  A source takes
every document ``whole`` times (0, 1 or 2) and once more those whose place lies below the source's
cut.  The cut is found from histograms of words by source and bucket of places: the bucket in which
the budget is reached is cut into finer buckets, and so on; nothing is sorted, and after the first
pass over the texts only (id, source, size) are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, forget, free_name, scratch, stored, words_of

#: Bits of a place, and those that one histogram resolves: 4096 buckets a source.
BITS, STEP = 60, 12
WEIGHTS = (5.0, 2.0, 1.0)


def place(id_col: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank), stored: rank from 0 by code point, null last.  Sources are dealt by
    range; what one task orders is a range of them, or one row for each range."""
    order = F.col("source").asc_nulls_last()
    ranges = stored(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return stored(ranges.withColumn("place", place).join(F.broadcast(bases), "part").select("source", "source_size", (F.col("base") + F.col("place")).alias("rank")), "mix-ranked")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, source_size): source, source_size, target.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all words; a
    target stops at ``most`` times its source's size and the excess is shared again by weight.
    That ends where each target is the lesser of its cap and one level times its weight.  The level
    starts as if no source were at its cap and is found again without those that are, until their
    number stays: a round is one aggregate over the sources, of which there may be any number.
    """
    weighed = _ranked(sizes).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", most * F.col("source_size"))
    level, full = None, -1
    while True:
        at_cap = F.lit(False) if level is None else F.col("cap") <= F.lit(level) * F.col("w")
        row = weighed.agg(
            F.sum("source_size").alias("words"),
            F.count_if(at_cap).alias("full"),
            F.coalesce(F.sum(F.when(at_cap, F.col("cap"))), F.lit(0.0)).alias("capped"),
            F.sum(F.when(~at_cap, F.col("w"))).alias("weight"),
        ).first()
        if row["full"] == full or row["weight"] is None:
            break
        full, level = row["full"], (share * row["words"] - row["capped"]) / row["weight"]
    target = F.col("cap") if level is None or row["weight"] is None else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return weighed.select("source", "source_size", target.alias("target"))


def _cuts(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, cut): the place below which a source's documents come nearest to its budget.

    ``budgets``: (source, budget), stored, budget below the source's size.
    """
    # state: the open interval [low, low + 2**left) of each source and the words taken below it
    step = None
    state = budgets.withColumns({"low": F.lit(0).cast("long"), "below": F.lit(0.0)})
    left = BITS
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    while left > 0:
        left -= STEP
        width = 1 << left
        s, d = broadcast_if_small(state).alias("s"), sized.alias("d")
        inside = (F.col("d.place") >= F.col("s.low")) & (F.col("d.place") < F.col("s.low") + F.lit(width << STEP))
        hist = (
            d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & inside)
            .groupBy("s.source", "s.budget", "s.low", "s.below", F.shiftright(F.col("d.place") - F.col("s.low"), left).alias("bucket"))
            .agg(F.sum("d.size").alias("words"), F.min("d.place").alias("first"), F.max("d.place").alias("last"))
        )
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("below") + F.sum("words").over(run))
        # the first bucket in which the words pass the budget
        at = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", "words", "upto", "first", "last")))
        old, step = step, stored(hist.groupBy("source", "budget", "low", "below").agg(at.alias("at")), "mix-step")
        if old is not None:
            forget(old)
        state = step.select(
            "source",
            "budget",
            (F.col("low") + F.coalesce(F.col("at.bucket"), F.lit(0)) * F.lit(width)).alias("low"),
            F.coalesce(F.col("at.upto") - F.col("at.words"), F.col("below")).alias("below"),
            F.col("at.words").alias("words"),
            F.col("at.first").alias("first"),
            F.coalesce(F.col("at.first") != F.col("at.last"), F.lit(False)).alias("many"),
        )
        if state.filter("many").isEmpty():
            break
    # one place is left in the boundary bucket: take it if that comes nearer
    nearer = F.col("below") + F.col("words") - F.col("budget") < F.col("budget") - F.col("below")
    return state.select("source", F.when(F.col("words").isNull(), F.lit(0)).when(nearer, F.col("first") + 1).otherwise(F.col("first")).cast("long").alias("cut"))


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target, whole, cut), stored; one row a source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets(sums, weights, share, most).withColumn("whole", F.floor(ratio).cast("long"))
    plan = stored(plan.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "mix-plan")
    cuts = stored(_cuts(sized, stored(plan.filter("source_size > 0").select("source", "budget"), "mix-budgets")), "mix-cuts")
    p, c = plan.alias("p"), cuts.alias("c")
    # a source at its cap has no budget left: no document of it is taken once more, with or without words
    cut = F.when(F.col("p.budget") > 0, F.coalesce("c.cut", F.lit(0))).otherwise(F.lit(0).cast("long"))
    return stored(
        p.join(c, F.col("p.source").eqNullSafe(F.col("c.source")), "left").select("p.source", "p.source_size", "p.target", "p.whole", cut.alias("cut")),
        "mix-cut-plan",
    )


def _sized(docs: DataFrame) -> DataFrame:
    size = F.size(words_of(F.col("text")))
    return stored(docs.select("doc_id", "source", size.cast("long").alias("size"), place(F.col("doc_id")).alias("place")), "mix-sized")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, times, taken.

    size counts words (0 for null or empty text); ``times`` is how often the mix takes the document
    and taken = times * size.  A document of a source is taken floor(target / source_size) times or
    once more, so that the source's taken words come as near its target as one document allows.
    Equal doc_ids share a place and are taken alike, null ones too.  A source without words has
    target 0 and its documents are taken 0 times.  An empty table gives no rows.  Depends on ids,
    sources and sizes alone: reruns agree.
    """
    with scratch() as keep:
        sized = keep(_sized(docs))
        plan = keep(_plan(sized, weights, share, most))
    d, p = sized.alias("d"), broadcast_if_small(plan).alias("p")
    times = F.col("p.whole") + F.when(F.col("d.place") < F.col("p.cut"), 1).otherwise(0)
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")))
    return joined.select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", times.cast("long").alias("times"), (times * F.col("d.size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (twice: two equal rows).

    The plan of the sources meets the rows themselves, so rows without an id or with the id of
    another row are taken as ``mix`` counts them.  Null and empty texts have size 0 and are taken as
    often as their place says, without weight in the mix.  Other columns may have any name.
    """
    source, held, times, copy = (free_name(docs, x) for x in ("_source", "_plan", "_times", "_copy"))
    with scratch() as keep:
        plan = keep(_plan(_sized(docs), weights, share, most))
    plan = broadcast_if_small(plan).select(F.col("source").alias(source), F.struct("whole", "cut").alias(held))
    joined = docs.join(plan, F.col("source").eqNullSafe(F.col(source)))
    found = (F.col(f"{held}.whole") + F.when(place(F.col("doc_id")) < F.col(f"{held}.cut"), 1).otherwise(0)).cast("int")
    repeated = joined.withColumn(times, found).filter(F.col(times) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))
