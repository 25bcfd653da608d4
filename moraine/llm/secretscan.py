"""Secret scan: fixed patterns, and two character Markov models for what no pattern names.

The models are first-order chains over ASCII characters, one of random strings and one of ordinary
identifiers, fitted to labelled strings: what the patterns find against the other words of a
bounded sample of documents.  A long token that no pattern took is a secret if its log-likelihood
ratio says so.  Scanning and training use built-in expressions alone.

Running sums over the hits of a text, which Spark has no function for, are folds over chunks of
about the square root of their number: the work grows as n ** 1.5 in copied integers, the rest as
n log n, so that a text full of hits is no trouble.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: The same with the least length in the pattern, where that finds the same: maximal runs.
SEARCH = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
KINDS = ("assign", "access", "hex", "markov")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
SPANS = "array<struct<start:int,kind:int,end:int,part:string>>"
CHARS = 128

#: Documents whose strings the models are fitted to, at most (in expectation).
MAX_TRAIN_DOCS = 8192
#: Log-likelihood ratio of a secret: in all, and for each pair of characters.
MIN_LLR, MIN_LLR_EACH = math.log(1e4), 0.25


def _chunk_size(n: Column) -> Column:
    return F.ceil(F.sqrt(n)).cast("int")


def _before(values: Column, op) -> Column:
    """For each of an array of integers what ``op`` (of which 0 is the identity) makes of those before it."""

    def fold(some: Column) -> Column:
        step = lambda s, x: F.struct(op(s["at"], x).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(some, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)

    def chunked(v: Column) -> Column:
        size = _chunk_size(F.size(v))
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int"))
        folded = F.transform(numbers, lambda j: fold(F.slice(v, j * size + 1, size)))
        bases = lambda ss: fold(F.transform(ss, lambda s: s["at"]))["out"]
        return let(folded, lambda ss: F.flatten(F.zip_with(ss, bases(ss), lambda s, b: F.transform(s["out"], lambda x: op(b, x).cast("int")))))

    return let(values, lambda v: F.when(F.size(v) > 0, chunked(v)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the matches in order, with the text of ``group``: lengths add up over the pieces
    between matches and the matches."""
    find = F.lit(pattern)

    def place(pieces: Column) -> Column:
        rows = F.arrays_zip(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("gap"),
            F.regexp_extract_all(text, find, F.lit(0)).alias("hit"),
            F.regexp_extract_all(text, find, F.lit(group)).alias("part"),
        )
        sized = F.transform(rows, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), x["part"].alias("part")))
        span = lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["hit"]).alias("end"), x["part"].alias("part"))
        placed = let(sized, lambda xs: F.zip_with(xs, _before(F.transform(xs, lambda x: x["gap"] + x["hit"]), lambda a, b: a + b), span))
        return F.filter(placed, lambda x: F.length(x["part"]) >= least).cast(SPANS)

    none = F.array().cast(SPANS)
    return let(F.split(text, pattern, -1), lambda pieces: F.when(F.size(pieces) > 1, place(pieces)).otherwise(none))


def _base(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start and kind."""
    parts = [_spans(text, k, SEARCH.get(name, p), group, least) for k, (name, p, group, least) in enumerate(PATTERNS)]
    return F.sort_array(F.concat(*parts))


def _free(tokens: Column, base: Column) -> Column:
    """Token spans (in order, none overlaps another) that no base span touches.

    A token is touched by as many base spans as start before its end less those that end by its
    start; both numbers are read from the place of the token among the sorted borders.
    """

    def ranks(mine: Column, others: Column, first: int) -> Column:
        """How many of ``others`` come before each of ``mine``; ``first``: 0 if mine go first where equal."""
        tag = lambda xs, t: F.transform(xs, lambda x: F.struct(x.alias("at"), F.lit(t).alias("t")))
        order = F.sort_array(F.concat(tag(mine, first), tag(others, 1 - first)))
        places = F.filter(F.transform(order, lambda x, i: F.struct(x["t"].alias("t"), i.alias("i"))), lambda x: x["t"] == first)
        return F.transform(places, lambda x, k: x["i"] - k)

    def untouched(t: Column) -> Column:
        column = lambda xs, name: F.transform(xs, lambda x: x[name])
        started = ranks(column(t, "end"), column(base, "start"), 0)
        ended = ranks(column(t, "start"), column(base, "end"), 1)
        touching = F.zip_with(started, ended, lambda a, b: a - b)
        kept = F.filter(F.zip_with(t, touching, lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda y: y["n"] == 0)
        return F.transform(kept, lambda y: y["x"])

    return let(tokens, lambda t: F.when((F.size(t) > 0) & (F.size(base) > 0), untouched(t)).otherwise(t))


def _ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of an ASCII token: the table's entries for its pairs, added up."""

    def add(codes: Column) -> Column:
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, a * CHARS + b))
        return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)

    return let(F.transform(F.split(token, ""), lambda c: F.ascii(c)), add)


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> list[float]:
    """The table of log ratios, CHARS * CHARS entries, whatever the size of ``docs``.

    Fitted to a sample of documents by hash of the id, ``max_docs`` in expectation.  Random strings
    are what the base patterns find there, ordinary ones the words of 6 characters or more that no
    such span touches.
    Counts are made by Spark; at most 2 * CHARS**2 of them come to the driver.  Unseen pairs have one
    count spread evenly over the 64 usual characters; without documents the table is all zero.
    """
    share = min(1.0, max_docs / max(1, docs.count()))
    sample = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("h"))
    sample = sample.filter(F.col("h") < int(math.ceil(share * (1 << 20)))).withColumn("base", _base(F.col("text")))
    values = F.transform("base", lambda b: b["part"])
    others = F.transform(_free(_spans(F.col("text"), 0, ORDINARY, 0, 6), F.col("base")), lambda t: t["part"])
    words = F.when(F.size("base") > 0, others).otherwise(F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0)))
    labelled = sample.select(F.explode(F.array(F.struct(F.lit(1).alias("y"), values.alias("t")), F.struct(F.lit(0).alias("y"), words.alias("t")))).alias("s"))
    strings = labelled.select("s.y", F.explode("s.t").alias("t")).groupBy("y", "t").agg(F.count(F.lit(1)).alias("n"))
    codes = F.transform(F.split("t", ""), lambda c: F.ascii(c))
    pairs = strings.withColumn("c", codes).filter(F.size("c") > 1)
    pair = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.least(a, F.lit(127)) * CHARS + F.least(b, F.lit(127)))
    counts = pairs.select("y", "n", F.explode(pair).alias("p")).groupBy("y", "p").agg(F.sum("n").alias("n")).collect()
    seen = {(r["y"], r["p"]): r["n"] for r in counts}
    row = {}
    for (y, p), n in seen.items():
        row[y, p // CHARS] = row.get((y, p // CHARS), 0) + n
    prior = 4.0  # pseudo-counts a row, spread over 64 characters
    log = lambda y, p: math.log((seen.get((y, p), 0) + prior / 64) / (row.get((y, p // CHARS), 0) + prior))
    return [round(log(1, p) - log(0, p), 4) for p in range(CHARS * CHARS)]


def _found(text: Column, table: list[float]) -> Column:
    """Spans (start, kind, end) of a text that is not null, by start and kind."""
    weights = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")

    def judged(t: Column) -> Column:
        return F.filter(t, lambda x: let(_ratio(x["part"], weights), lambda r: (r >= MIN_LLR) & (r >= MIN_LLR_EACH * (x["end"] - x["start"] - 1))))

    every = let(_base(text), lambda base: F.concat(base, judged(_free(_spans(text, 3, TOKEN, 0, 20), base))))
    return F.transform(F.sort_array(every), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """doc_id and ``spans``: array of (start, kind, end), kind an index into KINDS, by start and kind.

    Offsets are code points, end exclusive.  A null or empty text has none.  One row a row, repeated
    rows alike; other columns are not looked at.
    """
    return docs.select("doc_id", _found(F.coalesce("text", F.lit("")), table).alias("spans"))


def spans_string(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _masked(text: Column, spans: Column) -> Column:
    """The text with the characters of its spans as ``*``; spans may overlap, in order of their start."""

    def joined(cuts: Column) -> Column:
        """Of (at, gap, stars): text that stays from ``at`` on and stars after it.  Characters are
        counted from the start of a chunk of cuts, not of the text."""
        size = _chunk_size(F.size(cuts))

        def chunk(c: Column) -> Column:
            first, last = F.get(c, F.lit(0))["at"], F.element_at(c, -1)
            piece = lambda t: F.transform(c, lambda x: F.concat(F.substring(t, x["at"] - first + 1, x["gap"]), F.repeat(F.lit("*"), x["stars"])))
            return let(F.substring(text, first + 1, last["at"] + last["gap"] - first), piece)

        numbers = F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / size).cast("int"))
        pieces = F.flatten(F.transform(numbers, lambda j: let(F.slice(cuts, j * size + 1, size), chunk)))
        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))

    def cut(x: Column, upto: Column) -> Column:
        gap = F.greatest(x["start"] - upto, F.lit(0))
        stars = F.greatest(x["end"], upto) - F.greatest(x["start"], upto)
        return F.struct(upto.alias("at"), gap.alias("gap"), stars.alias("stars"))

    cuts = F.zip_with(spans, _before(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), cut)
    return F.when(F.size(spans) > 0, let(cuts, joined)).otherwise(text)


def redact(docs: DataFrame, table: list[float]) -> DataFrame:
    """doc_id and the text with each span's characters as ``*``, row by row; null stays null."""
    text = F.col("text")
    masked = let(_found(text, table), lambda spans: _masked(text, spans))
    return docs.select("doc_id", F.when(text.isNotNull(), masked).alias("text"))
