"""Near duplicates by bottom-k sketches from one hash function.

1. A text's shingle set is hashed once; its sketch is the K least hashes.  Texts with the same words
   in the same order (BLAKE2b of the words) become one class and go on as its least id.
2. Inverted lists: retained value -> classes.  Two sets with Jaccard t share at least ``need`` of
   their retained values but for one pair in MISS, so each class enters only its rarest
   ``K - need + 1`` values, rarest by the number of classes: one of these is shared.  Values that
   a common passage gives to thousands of texts come last and stay out.  Lists are cut by size,
   since linked sets have similar sizes.
3. Pairs are estimated by the union of their sketches, and those that pass are counted exactly on
   the words of both texts.
4. Of a list, members are first paired with its most ordinary one only, and components are taken.
   So a list of copies costs as many pairs as it has members.
5. Members of lists that still hold several components go on with their whole sets: exact prefix
   lists by bands of size, in which a set that is far from the centre of its group has only values
   of its own.  They are paired with the most ordinary member, then those pairs follow that the
   components still separate, so no link between components is lost.

With ``exact`` all classes go to step 5 at once and no pair is estimated, so MISS plays no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, scratch, skew_join, stored, without
from .graph import components
from .shingles import shingle_sets, text_bytes

K = 32
#: Texts of an Arrow batch that are held as hashes or words at once.
SLICE = 500
#: Bands of size between a set and the smallest one that it can be linked with.
BANDS = 8
#: Pairs of one text that are compared by one task, about.
PAIRS = 200
#: Odds that a pair just at the threshold is not found.
MISS = 1e-6


def needed(percent: int, k: int = K, miss: float = MISS) -> int:
    """Retained values that two linked sets share, but with odds ``miss``: the lower tail of a
    binomial of k draws (drawing without replacement has a lighter one)."""
    t, tail = percent / 100, 0.0
    for m in range(k + 1):
        tail += math.comb(k, m) * t**m * (1 - t) ** (k - m)
        if tail > miss:
            return max(1, m)
    return k


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def text_hash() -> Column:
    """Tells the texts of rows with one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text): the text of each class in ``ids``."""
    named = classes.join(broadcast_if_small(ids), "id", "left_semi").select("id", F.col("rep").alias("_rep"), F.col("h").alias("_h"))
    named = stored(named, "near-text-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("_rep"), text_hash().alias("_h"), "text")
    return rows.join(broadcast_if_small(named), ["_rep", "_h"]).select("id", "text").dropDuplicates(["id"])


def sketches(docs: DataFrame, size: int = 5, k: int | None = K) -> DataFrame:
    """id, h (hash of the text), n (size of the shingle set), fp (binary fingerprint of the lower-cased
    words in order), sketch (array<long>, ascending; the whole set if k is None).

    A text of fewer than ``size`` words has its whole sequence as one shingle; a null text or one
    without words has the empty set, n 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            data, ends = text_bytes(batch.column("text"))
            fps = [hashlib.blake2b(b" ".join(data[a:b].tobytes().lower().split()), digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:])]
            ns, kept = [], []
            for s in shingle_sets(batch.column("text"), size):
                ns.append(len(s))
                kept.append(s[:k])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32)
            flat = np.concatenate([*kept, np.zeros(0, np.int64)])
            out = {"id": batch.column("id"), "h": batch.column("h"), "n": pa.array(ns, pa.int64()), "fp": pa.array(fps, pa.binary()), "sketch": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long").alias("id"), text_hash().alias("h"), "text").mapInArrow(run, "id long, h long, n long, fp binary, sketch array<long>")


def _ordered(sets: DataFrame) -> DataFrame:
    """(id, n, vs): of each class the values that other classes have too, rarest first, as (c, v)."""
    values = sets.select("id", "n", F.explode("sketch").alias("v"))
    counts = stored(values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "near-counts")
    return values.join(broadcast_if_small(counts), "v").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"))


def _index(reps: DataFrame, percent: int, k: int) -> DataFrame:
    """(v, id, n, own): the entries of each class in the lists that more than one class shares, and
    how many retained values the class has for itself."""
    need = F.least(F.lit(needed(percent, k)), F.ceil(F.col("n") * percent / 100))
    mine = F.least(F.col("n"), F.lit(k))
    own = mine - F.size("vs")
    # values that no other class has come first in the order and fill places without an entry
    places = mine - need + 1 - own
    entries = F.explode(F.slice("vs", F.lit(1), F.greatest(places, F.lit(0)).cast("int")))
    return _ordered(reps).select("id", "n", own.alias("own"), entries.alias("e")).select("e.v", "id", "n", "own")


def _whole_lists(docs: DataFrame, classes: DataFrame, ids: DataFrame, percent: int, size: int) -> DataFrame:
    """(v, s, home, id, n, own, at): prefix lists of the whole sets of the classes ``ids``.

    Linked sets of na <= nb values share ``o`` = ceil(t / (1 + t) * (na + nb)) of them, so their first
    na - o + 1 and nb - o + 1 values, rarest first, have one in common.  A set is at home in its band
    of sizes, where partners are no smaller, and a guest in the bands that smaller partners can have.
    ``at`` is the place of the value in the order.
    """
    step = math.log(100 / percent) / BANDS
    texts = _texts(docs, classes, ids)
    sets = stored(sketches(texts.withColumnRenamed("id", "doc_id"), size, None).select("id", "n", "sketch"), "near-sets")
    least = F.ceil(F.col("n") * percent / 100)
    band = lambda n: F.floor(F.log(n) / step + 1e-9).cast("int")
    guest = F.transform(F.sequence(band(least), band(F.col("n"))), lambda b: F.struct(b.alias("s"), F.lit(False).alias("home"), F.greatest(least, F.floor(F.exp(b * step) * (1 - 1e-8))).alias("m")))
    home = F.array(F.struct(band(F.col("n")).alias("s"), F.lit(True).alias("home"), F.col("n").alias("m")))
    roles = _ordered(sets).select("id", "n", "vs", (F.col("n") - F.size("vs")).alias("own"), F.explode(F.concat(home, guest)).alias("r"))
    share = F.ceil((F.col("n") + F.col("r.m")) * percent / (100 + percent) - 1e-9)
    places = F.greatest(F.col("n") - share + 1 - F.col("own"), F.lit(0)).cast("int")
    entries = roles.select("id", "n", "own", "r.s", "r.home", F.posexplode(F.slice("vs", F.lit(1), places)).alias("i", "e"))
    return entries.select("e.v", "s", "home", "id", "n", "own", (F.col("own") + F.col("i")).alias("at"))


def _star(lists: DataFrame) -> DataFrame:
    """(a, b, na, nb): each member of a list with the one at home there that has least for itself."""
    heads = lists.groupBy("v", "s").agg(F.min(F.when(F.col("home"), F.struct("own", "id", "n"))).alias("h"), F.count(F.lit(1)).alias("c")).filter("h is not null and c > 1")
    return lists.join(heads, ["v", "s"]).select(F.col("h.id").alias("a"), F.col("h.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb"))


def _placed(lists: DataFrame, found: DataFrame) -> DataFrame:
    return lists.join(broadcast_if_small(found), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")


def _between(lists: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): pairs of members of a list that the components separate.

    Members of the largest component of a list are never held against each other.
    """
    placed = _placed(lists, found)
    sizes = placed.groupBy("v", "s", "comp").agg(F.count(F.lit(1)).alias("c"))
    most = sizes.groupBy("v", "s").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    open_ = stored(placed.join(most, ["v", "s"]).withColumn("odd", F.col("comp") != F.col("most")), "near-open")
    homes, guests = open_.filter("home"), open_.filter("not home")

    def held(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
        left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
        enough = (100 + percent) * left >= percent * (F.col("x.n") + F.col("y.n"))
        on = (F.col("x.v") == F.col("y.v")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.comp") != F.col("y.comp"))
        return x.join(y, on & order & enough).select(F.col("x.id").alias("a"), F.col("x.n").alias("na"), F.col("y.id").alias("b"), F.col("y.n").alias("nb"))

    return held(homes, guests.filter("odd")).unionAll(held(homes.filter("odd"), guests.filter("not odd")))


def _estimate(a: Column, b: Column, na: Column, nb: Column, percent: int, k: int) -> Column:
    """Whether the sketch of the union has enough values of both."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    whole = (na <= k) & (nb <= k)
    exact = 100 * F.size(F.array_intersect(a, b)) >= percent * F.size(F.array_union(a, b))
    return F.when(whole, exact).otherwise(both >= F.least(F.lit(needed(percent, k)), F.ceil(F.size(union) * percent / 100)))


def _word_sets(text: str | None, size: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def _with_text(rows: DataFrame, pairs: DataFrame, texts: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """``rows`` of ``pairs`` (stored), with the text of ``key`` as ``name``.

    A text with more than PAIRS pairs is copied once for about as many, which are dealt by ``other``."""
    many = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > PAIRS)
    many = stored(many.select(F.col(key), F.ceil(F.col("c") / PAIRS).cast("int").alias("_copies")), "near-many")
    salt = F.coalesce(F.pmod(F.xxhash64(other), F.col("_copies")), F.lit(0)).cast("int")
    dealt = rows.join(broadcast_if_small(many), key, "left").withColumn("_salt", salt).drop("_copies")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))
    text = texts.select(F.col("id").alias(key), F.col("text").alias(name)).join(broadcast_if_small(many), key, "left").withColumn("_salt", copies).drop("_copies")
    return dealt.join(text, [key, "_salt"]).drop("_salt")


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, size: int) -> DataFrame:
    """Those of (a, b) whose full sets of shingles, as words, are close enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, set()
        for batch in _slices(batches):
            ok = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                if a != held:
                    held, mine = a, _word_sets(x, size)
                other = _word_sets(y, size)
                both = len(mine & other)
                ok.append(100 * both >= percent * (len(mine) + len(other) - both) and both > 0)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(ok, pa.bool_()))

    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    texts = _texts(docs, classes, ids)
    both = _with_text(_with_text(pairs, pairs, texts, "b", "a", "y"), pairs, texts, "a", "b", "x")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _classes(rows: DataFrame) -> DataFrame:
    """(id, fp, rep, h, members): each fingerprint, the least doc_id that has it and the hash of its text
    there.  ``id`` is that doc_id too, but for texts that share it: these have ids of their own."""
    found = rows.filter("n > 0 and id is not null").groupBy("fp").agg(F.min(F.struct("id", "h")).alias("rep"), F.count(F.lit(1)).alias("members"))
    found = stored(found.select("fp", F.col("rep.id").alias("rep"), F.col("rep.h").alias("h"), "members"), "near-classes")
    shared = stored(found.groupBy("rep").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("rep", "first"), "near-shared")
    named = found.withColumn("id", F.col("rep"))
    if shared.isEmpty():
        return named
    top = rows.agg(F.max("id")).first()[0]
    own = F.col("first").isNotNull() & (F.col("fp") != F.col("first"))
    split = found.join(broadcast_if_small(shared), "rep", "left").select("fp", "rep", "h", "members", own.alias("own"))
    extra = split.filter("own").withColumn("id", F.lit(top) + 1 + F.monotonically_increasing_id()).drop("own")
    return stored(split.filter("not own").drop("own").withColumn("id", F.col("rep")).unionByName(extra), "near-split-classes")


def _named(rows: DataFrame, docs: DataFrame, percent: int, size: int, k: int, exact: bool) -> DataFrame:
    """(fp, component, members), stored: the component of each sequence of words."""
    classes = _classes(rows)
    firsts = classes.select(F.col("rep").alias("_rep"), F.col("fp").alias("_fp"), F.col("id").alias("_class"))
    reps = rows.join(firsts, (F.col("id") == F.col("_rep")) & (F.col("fp") == F.col("_fp"))).select(F.col("_class").alias("id"), "n", "sketch")
    reps = stored(reps.dropDuplicates(["id"]), "near-reps")

    close = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")

    def accepted(pairs: DataFrame) -> DataFrame:
        """Of (a, b, na, nb): the links."""
        pairs = pairs.filter(close & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        sa, sb = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
        if not exact:
            pairs = pairs.join(sb, "b").join(sa, "a").filter(_estimate(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), percent, k)).select("a", "b")
        return stored(_verify(stored(pairs, "near-likely"), docs, classes, percent, size), "near-links")

    if exact:
        open_, links = stored(reps.select("id"), "near-open-ids"), docs.sparkSession.createDataFrame([], "a long, b long")
        found = stored(components(links), "near-components")
    else:
        # lists by value and size: linked sizes are in one class of sizes or in neighbouring ones
        step = math.log(100 / percent)
        entries = _index(reps, percent, k).withColumn("s", F.floor(F.log("n") / step + 1e-9).cast("int"))
        lists = stored(entries.select("v", "id", "n", "own", F.explode(F.array(F.struct(F.col("s"), F.lit(True).alias("home")), F.struct((F.col("s") - 1).alias("s"), F.lit(False).alias("home")))).alias("t")).select("v", "t.s", "t.home", "id", "n", "own"), "near-lists")
        links = accepted(_star(lists))
        found = stored(components(links), "near-components")

        # members of lists that have more than one component still
        placed = _placed(lists, found)
        mixed = placed.groupBy("v", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("home").alias("any")).filter("lo < hi and any").select("v", "s")
        open_ = stored(placed.join(mixed, ["v", "s"], "left_semi").select("id").distinct(), "near-open-ids")

    if not open_.isEmpty():
        whole = stored(_whole_lists(docs, classes, open_, percent, size), "near-whole")
        links = links.unionAll(accepted(_star(whole)))
        found = stored(components(links), "near-components")
        more = accepted(_between(whole, found, percent))
        if not more.isEmpty():
            found = stored(components(links.unionAll(more)), "near-components")

    named = classes.join(broadcast_if_small(found), "id", "left").select("id", "rep", "fp", F.coalesce("component", "id").alias("component"), "members")
    if not classes.filter("id <> rep").isEmpty():
        # a component by the least doc_id in it
        named = stored(named.withColumn("component", F.col("component").cast("string")), "near-placed")
        least = stored(named.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("classes")), "near-least")
        named = skew_join(named, least, "component", "classes", "id").withColumn("component", F.col("least"))
    return stored(named.select("fp", "component", "members"), "near-named")


def _rows(docs: DataFrame, percent: int, size: int, k: int, exact: bool) -> DataFrame:
    """``near_components`` and h, the hash of the row's text.  Of what is stored on the way only the
    sketches and the table of classes stay."""
    with scratch() as keep:
        rows = keep(stored(sketches(docs, size, k), "near-sketches"))
        named = keep(_named(rows, docs, percent, size, k, exact))
    joined = skew_join(rows.select("id", "h", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")), named, "fp", "members", "id")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return joined.select("id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def near_components(docs: DataFrame, percent: int = 80, size: int = 5, k: int = K, exact: bool = False) -> DataFrame:
    """id, n_shingles, component_id, kept for each row of ``docs``.

    Texts are linked when 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the least id that links reach, kept the rows with that id.  Empty sets are
    linked with nothing.  Rows with one id and different texts are searched each by its own text.
    A text that only rows without an id have is linked with nothing.

    A pair just at the threshold stays unlinked with odds of MISS.  ``exact`` finds every link, but
    for chance equality of 64-bit hashes, at the price of whole sets of all classes in prefix lists.
    """
    return _rows(docs, percent, size, k, exact).drop("h")


def near_dedup(docs: DataFrame, percent: int = 80, size: int = 5, exact: bool = False) -> DataFrame:
    """The rows of ``docs``, whole, that are the least of their component; null ids stay."""
    with scratch() as keep:
        dropped = _rows(docs, percent, size, K, exact).filter(~F.col("kept") & F.col("id").isNotNull())
        dropped = keep(stored(dropped.select("id", F.col("h").alias("digest")).distinct(), "near-dropped"))
    return without(docs, dropped, text_hash())
