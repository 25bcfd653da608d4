"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams by language are added up by Spark from a bounded sample of labelled
rows.  The matrix of log probabilities (BUCKETS x languages) is broadcast in parts of LABELS
languages, so that no part grows with the number of labels; a batch of texts is scored as a sparse
matrix of n-gram occurrences (indices and row offsets) times that matrix, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, stored

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: Languages of one part of the matrix, which has 4 * BUCKETS bytes a language: 8 MB at most.
LABELS = 64
#: Rows of each language that the model is fitted to, at most (in expectation).
MAX_TRAIN_DOCS = 5000
#: Characters scored at once, and entries of the matrix looked up at once; longer texts go through in pieces.
PIECE, CELLS = 1 << 18, 1 << 20
UNKNOWN = "und"
#: A language is told if the n-grams are likelier under it than by chance (one bucket in BUCKETS), and
#: than under the next language by this much (natural logarithm) for each n-gram.
MIN_MARGIN = 0.25
#: How far a margin that is too small must lie below that to count: so many standard deviations of the mean
#: over a text's n-grams, of which every len(ORDERS)-th tells something of its own.
SIGMAS, DEVIATION = 3.0, 1.5

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


@dataclass(frozen=True)
class Part:
    """Some of the languages of a model."""

    languages: list[str]
    #: (BUCKETS, languages), log P(bucket | language)
    matrix: np.ndarray
    #: log P(language)
    prior: np.ndarray


@dataclass(frozen=True)
class Model:
    """Counts in stored tables: (lang, n) of labelled rows, (lang, bucket, n) of n-grams."""

    sizes: DataFrame
    counts: DataFrame
    rows: int
    alpha: float

    def parts(self) -> Iterator[Part]:
        """The languages in order, LABELS at a time; the driver holds one part."""
        last = None
        while self.rows:
            rest = self.sizes if last is None else self.sizes.filter(F.col("lang") > last)
            some = rest.orderBy("lang").limit(LABELS).collect()
            if not some:
                return
            languages = [r["lang"] for r in some]
            last, at = languages[-1], {x: i for i, x in enumerate(languages)}
            body = self.counts.filter(F.col("lang").isin(languages)).toArrow()
            matrix = np.zeros((BUCKETS, len(languages)))
            column = np.array([at[x] for x in body.column("lang").to_pylist()], dtype=np.int64)
            matrix[body.column("bucket").to_numpy(), column] = body.column("n").to_numpy()
            matrix = np.log((matrix + self.alpha) / (matrix.sum(axis=0) + self.alpha * BUCKETS))
            yield Part(languages, matrix.astype(np.float32), np.log(np.array([r["n"] for r in some]) / self.rows))


def _pieces(texts: list[str | None], size: int) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Groups of (row, characters, how many n-grams start there) of about ``size`` characters."""
    rows: list[int] = []
    parts: list[str] = []
    starts: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for at in range(0, len(low), size):
            n = min(size, len(low) - at)
            rows.append(i)
            parts.append(low[at : at + n + len(ORDERS) - 1])
            starts.append(n)
            held += n
            if held >= size:
                yield rows, parts, starts
                rows, parts, starts, held = [], [], [], 0
    if rows:
        yield rows, parts, starts


def features(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: rows, offsets and buckets, a sparse matrix by rows without counts.

    Row ``rows[k]`` has the buckets from ``offsets[2 * k]`` to ``offsets[2 * k + 1]`` of each order.
    """
    gap = "\0" * len(ORDERS)
    for rows, parts, starts in _pieces(texts, size):
        codes = np.frombuffer((gap.join(parts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(p) for p in parts]) + len(gap)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        offsets = np.stack([first, first + np.array(starts)], axis=1).ravel()
        usable = len(codes) - len(gap) + 1
        buckets, hashed = [], np.zeros(usable, dtype=np.uint32)
        for k in range(len(ORDERS)):
            hashed = (hashed ^ codes[k : k + usable]) * _MULTIPLIERS[k]
            hashed ^= hashed >> np.uint32(15)
            buckets.append(((hashed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64))
        yield np.array(rows), offsets, np.stack(buckets)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})
        totals.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for rows, offsets, buckets in features(batch.column("text").to_pylist()):
            for k, row in enumerate(rows):
                if len(totals) >= LABELS and langs[row] not in totals:
                    yield from flush()
                seen = buckets[:, offsets[2 * k] : offsets[2 * k + 1]].ravel()
                total = totals.setdefault(langs[row], np.zeros(BUCKETS, dtype=np.int64))
                total += np.bincount(seen, minlength=BUCKETS)
    yield from flush()


def train(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS, alpha: float = 0.1) -> Model:
    """Fit to (doc_id, text, lang); rows with a null text or lang teach nothing.

    At most ``max_docs`` rows a language in expectation, taken by hash of the id.  There may be any
    number of languages: counts stay in stored tables.  Without rows the model knows no language.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang-sizes")
    limit = F.ceil(F.lit(max_docs << 20) / F.col("n"))
    sample = rows.join(broadcast_if_small(sizes), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit).select("text", "lang")
    counts = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(sizes, stored(counts, "lang-counts"), sizes.agg(F.sum("n")).first()[0] or 0, alpha)


def likelihoods(texts: list[str | None], part: Part) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text (with the prior) under each language, and its number of n-grams."""
    total, n = np.tile(part.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    size = min(PIECE, max(1 << 12, CELLS // len(part.languages)))
    for rows, offsets, buckets in features(texts, size):
        found = np.zeros((len(rows), len(part.languages)))
        for order in buckets:
            # the sentinel row keeps reduceat in range; odd entries are the gaps between texts
            looked = part.matrix[order]
            found += np.add.reduceat(looked, np.minimum(offsets, len(looked) - 1), axis=0, dtype=np.float64)[::2]
        np.add.at(total, rows, found)
        np.add.at(n, rows, len(ORDERS) * (offsets[1::2] - offsets[::2]))
    return total, n


_SCORE = "struct<best:string,top:double,second:double,all:double,n:long>"


def _part_scores(part) -> Column:
    """Of the column text: best language of a broadcast part, its log likelihood, the next one's, the
    logarithm of the sum of all, and the number of n-grams."""

    @F.arrow_udf(_SCORE)
    def scores(text: pa.Array) -> pa.Array:
        p = part.value
        total, n = likelihoods(text.to_pylist(), p)
        best = total.argmax(axis=1)
        top = total.max(axis=1)
        ranked = np.partition(total, -2, axis=1)[:, -2] if len(p.languages) > 1 else np.full(len(total), -np.inf)
        every = top + np.log(np.exp(total - top[:, None]).sum(axis=1))
        fields = [pa.array([p.languages[b] for b in best], pa.string()), pa.array(top), pa.array(ranked), pa.array(every), pa.array(n)]
        return pa.StructArray.from_arrays(fields, ["best", "top", "second", "all", "n"])

    return scores(F.col("text"))


def _scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the column ``name``: scores over all parts (null if the model has none)."""
    out, first = docs.withColumn(name, F.lit(None).cast(_SCORE)), True
    for part in model.parts():
        if not first:  # one part in a worker's memory at a time
            out = stored(out, "lang-scored")
        new = _part_scores(docs.sparkSession.sparkContext.broadcast(part))
        if first:
            out, first = docs.withColumn(name, new), False
            continue
        a, b = F.col(name), F.col(f"{name}_new")
        merged = F.struct(
            F.when(b["top"] > a["top"], b["best"]).otherwise(a["best"]).alias("best"),
            F.greatest(a["top"], b["top"]).alias("top"),
            F.greatest(a["second"], b["second"], F.least(a["top"], b["top"])).alias("second"),
            (F.greatest(a["all"], b["all"]) + F.log1p(F.exp(-F.abs(a["all"] - b["all"])))).alias("all"),
            a["n"].alias("n"),
        )
        out = out.withColumn(f"{name}_new", new).withColumn(name, merged).drop(f"{name}_new")
    return out


def held_out(id_col: Column) -> Column:
    """True for the quarter of ids that training leaves out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row; of a text only its characters count.

    score is the posterior probability of the language.  ``und`` with score 0 where the text is null
    or has no letter, or the model knows no language.  An empty table gives no rows.
    """
    found = _scored(docs.select("doc_id", "text"), model, "s")
    told = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.col("s").isNotNull()
    score = F.when(told, F.least(F.exp(F.col("s.top") - F.col("s.all")), F.lit(1.0))).otherwise(F.lit(0.0))
    return found.select("doc_id", F.when(told, F.col("s.best")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def known_language(docs: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language the model, fitted to their labels, can tell.

    Rejected: null texts and texts without a letter; texts that are no likelier under the best
    language than by chance, as in another script or noise; and those between two languages, where
    the best is not likelier than the next by ``min_margin`` for each n-gram.  Both count by n-gram,
    so a long text is judged as a short one, but what a few n-grams say is less certain: a text goes
    only if its margin is too small by SIGMAS standard deviations, which shrink as the root of the
    number of n-grams.  Where no row has a label, there is nothing to reject by but the letters.  Only the text goes to Python; other columns may have any name.
    """
    name = free_name(docs, "_scored")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    found = _scored(lettered, model, name)
    x = F.col(name)
    error = F.lit(SIGMAS * DEVIATION * float(np.sqrt(len(ORDERS)))) * F.sqrt(x["n"])
    told = (x["top"] > -x["n"] * float(np.log(BUCKETS))) & (x["top"] - x["second"] >= F.lit(min_margin) * x["n"] - error)
    return found.filter(x.isNull() | told).drop(name)
