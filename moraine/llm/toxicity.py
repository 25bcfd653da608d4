"""Toxicity: noisy-channel deobfuscation, then a score of the restored words.

A disguised word is what a channel made of plain text: letters became look-alikes, were repeated, or
were set apart by blanks or marks.  What may stand behind a stretch of such text is a lattice of
characters; Viterbi's algorithm finds the likeliest path through it under a character trigram model,
which Spark counts over all documents.  Text that has no such stretch restores to itself.

The restored text is scored by naive Bayes over its distinct words, with weights from labelled rows,
and a logistic fit of the sums (each labelled row left out of its own weights) gives the probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: What a look-alike may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
    "€": "e", "£": "l", "(": "c", "¡": "i",
}
#: Marks that set letters apart.
MARKS = ".-_*~'’,:;/\\^=`·•"
#: Symbols of the model: 0 is a border of words, 1 to 26 are a to z, other letters share the rest.
SYMBOLS = 64
#: Costs of the channel in nats: a look-alike read as itself (a border), as a letter, a mark as nothing, a
#: run of three or more letters as two, one blank between single letters as a border.
AS_ITSELF, AS_LETTER, AS_NOTHING, AS_TWO, AS_BORDER = 4.0, 1.0, 0.7, 1.0, 3.0
#: Labelled rows of each class that weights are fitted to, at most: those with the least hashes of their id.
MAX_TRAIN_DOCS = 10_000
#: A word has a weight if so many toxic rows have it, each with other neighbours, and if that is so many
#: standard deviations more than its share.  Words with a weight, at most.
MIN_SUPPORT, MIN_SIGMAS, MAX_WORDS = 3, 5.0, 1 << 16
#: Stretches that a worker remembers, and the longest; all are forgotten when there are more.
MEMO_ROWS, MEMO_CHARS = 1 << 16, 64
#: Scores from here on are called toxic.
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")
_EDGE = "".join(sorted(set(MARKS) | set("!?|()[]{}<>\"“”«»")))
#: What a character can be in a stretch.
_BLANK, _LETTER, _LIKE, _MARK, _OTHER = range(5)

_KIND = np.full(0x110000, 255, np.uint8)
_SYMBOL = np.zeros(0x110000, np.uint8)


def _symbols() -> np.ndarray:
    """Symbol of each code point, built once a process."""
    if not _SYMBOL[ord("a")]:
        points = np.arange(0x110000)
        _SYMBOL[:] = np.where(_kinds() == _LETTER, 27 + points % (SYMBOLS - 27), 0)
        _SYMBOL[97:123] = np.arange(1, 27)
    return _SYMBOL


def _kinds() -> np.ndarray:
    """Kind of each code point, built once a process."""
    if _KIND[0] == 255:
        _KIND[:] = _OTHER
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                _KIND[point] = _LETTER
            elif c.isspace():
                _KIND[point] = _BLANK
        for c in LOOK_ALIKES:
            _KIND[ord(c)] = _LIKE
        for c in MARKS:
            _KIND[ord(c)] = _MARK
    return _KIND


def _symbol(letter: str) -> int:
    at = ord(letter)
    return at - 96 if 97 <= at <= 122 else 27 + at % (SYMBOLS - 27)


def trigrams(texts: list[str | None]) -> np.ndarray:
    """(SYMBOLS ** 3,): how often each three symbols follow each other in the texts, in lower case; what is
    no letter is a border, and each text has two on either side."""
    codes = np.frombuffer(("\n\n" + "\n\n".join((t or "").lower() for t in texts) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _symbols()[codes].astype(np.int32)
    # one border between words: a trigram model learns nothing from longer gaps
    s = s[np.concatenate(([True, True], (s[2:] > 0) | (s[1:-1] > 0) | (s[:-2] > 0)))]
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        texts, held = batch.column("text").to_pylist(), 0
        first = 0
        for i, t in enumerate(texts):  # about a million characters at once
            held += len(t or "")
            if held > 1 << 20 or i == len(texts) - 1:
                total += trigrams(texts[first : i + 1])
                first, held = i + 1, 0
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """(SYMBOLS, SYMBOLS, SYMBOLS): log P(third | first, second) from all texts (column text).

    Each task adds its texts up, so SYMBOLS^3 numbers at most come from it and to the driver.  Counts are
    smoothed by those of the shorter contexts.
    """
    found = docs.select("text").mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SYMBOLS**3)
    n[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = n.sum(axis=0), n.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((n + 5 * p2[None]) / (n.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def lattice(stretch: str, apart: bool) -> list[list[tuple[str, float]]]:
    """The choices at each place of a stretch in lower case: what may stand there, and at what cost.  "" is
    nothing, " " a border of words.  ``apart``: its characters stand apart, and blanks are choices too."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(stretch):
        c = stretch[i]
        j = i + 1
        while j < len(stretch) and stretch[j] == c:
            j += 1
        n, i = j - i, j
        if c.isspace():
            one = apart and n == 1 and (i == len(stretch) or not stretch[i].isspace())
            out.append([("", 0.0), (" ", AS_BORDER)] if one else [(" ", 0.0)])
        elif c in LOOK_ALIKES:
            letters = [(x * k, AS_LETTER + AS_TWO * (k - 1)) for x in LOOK_ALIKES[c] for k in range(1, min(n, 2) + 1)]
            out.append([*letters, (" ", AS_ITSELF)])
        elif c.isalpha():
            out.append([(c * n, 0.0)] if n < 3 else [(c, 0.0), (c * 2, AS_TWO)])
        elif c in MARKS:
            out.append([("", AS_NOTHING), (" ", 0.0)])
        else:
            out.append([(" ", 0.0)])
    if apart:  # one letter set apart again and again is one run of it
        out = _merged(out)
    return out


def _merged(places: list[list[tuple[str, float]]]) -> list[list[tuple[str, float]]]:
    """Runs of three and more equal letters over blanks become one place."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(places):
        j = i
        while j + 2 < len(places) and places[j + 2] == places[i] and places[j + 1][0][0] == "" and len(places[i]) == 1:
            j += 2
        if j - i >= 4:
            c = places[i][0][0]
            out.append([(c, 0.0), (c * 2, AS_TWO)])
        else:
            out += places[i : j + 1]
        i = j + 1
    return out


def viterbi(places: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest text through a lattice; of equal ones that with the first choices."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for choices in places:
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in best.items():
            for text, price in choices:
                x, y, total = a, b, cost + price
                for c in text:
                    s = 0 if c == " " else _symbol(c)
                    if s == 0 and y == 0:
                        continue  # borders in a row are one
                    total -= model[x, y, s]
                    x, y = y, s
                old = after.get((x, y))
                if old is None or total < old[0]:
                    after[x, y] = (total, (path, text))
        best = after
    ends = [(cost - (model[a, b, 0] if b else 0.0), path) for (a, b), (cost, path) in best.items()]
    path = min(ends, key=lambda e: e[0])[1]
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


class Restorer:
    """Restores texts; what short stretches restore to is remembered."""

    def __init__(self, model: np.ndarray):
        self.model, self.memo = model, {}

    def stretch(self, text: str, apart: bool) -> str:
        found = self.memo.get((text, apart))
        if found is None:
            found = viterbi(lattice(text, apart), self.model)
            if len(text) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_ROWS:
                    self.memo.clear()
                self.memo[text, apart] = found
        return found

    def words(self, text: str | None) -> list[str]:
        """The words of the restored text, in order and in lower case; none for null."""
        low = (text or "").lower()
        out, at = [], 0
        for start, end, apart in self._stretches(low):
            out += _WORD.findall(low, at, start)
            out += self.stretch(low[start:end], apart).split()
            at = end
        return out + _WORD.findall(low, at)

    @staticmethod
    def _stretches(low: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, apart) of stretches that may be disguised, in order and disjoint: three and more
        single characters apart; else tokens with look-alikes or marks between letters, with a
        look-alike before the first letter, or with three equal letters."""
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) < 2:
            return
        kind = _kinds()[codes]
        framed = np.concatenate(([_BLANK], kind, [_BLANK]))
        blanks = np.flatnonzero(framed == _BLANK) - 1  # of the text's places, and one on either side
        signs = (framed == _LIKE) | (framed == _MARK)
        first = np.flatnonzero(signs[1:] & ~signs[:-1])  # of each run of signs: the place before, in framed
        last = np.flatnonzero(signs[:-1] & ~signs[1:])
        before, after = framed[first], framed[last + 1]
        inside = (after == _LETTER) & ((before == _LETTER) | (before == _BLANK) & (framed[last] == _LIKE))
        thrice = np.flatnonzero((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & (kind[2:] == _LETTER))
        at = np.searchsorted(blanks, np.union1d(first[inside], thrice), side="right")
        tokens = np.unique(np.stack([blanks[at - 1] + 1, blanks[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), int)
        single = np.flatnonzero((framed[:-2] == _BLANK) & (framed[2:] == _BLANK) & ((kind == _LETTER) | (kind == _LIKE)))
        runs = []
        if len(single) >= 3:
            token = np.searchsorted(blanks, single)  # singles with nothing but blanks between are one run
            gap = np.array([0, *np.cumsum(np.diff(blanks) > 1)])[token - 1]
            cut = np.flatnonzero(np.concatenate(([True], np.diff(gap) > 1, [True])))
            runs = [(int(single[i]), int(single[j - 1]) + 1, True) for i, j in zip(cut, cut[1:]) if j - i >= 3]
        for start, end, apart in sorted([*runs, *((int(i), int(j), False) for i, j in tokens)]):
            if not apart:  # punctuation around a word belongs to no stretch
                while end > start and low[end - 1] in _EDGE:
                    end -= 1
                while start < end and low[start] in _EDGE and low[start] not in LOOK_ALIKES:
                    start += 1
            if start < end:
                yield start, end, apart


@dataclass(frozen=True)
class Model:
    """The language model, the weight of each word, and the logistic fit of a text's sum of weights."""

    letters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -4.0

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * total + self.offset, -500, 500)))


def held_out(id_col: Column) -> Column:
    """True for the third of ids that training leaves out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _evidence(letters) -> object:
    """Of labelled texts: (row, toxic, word, context), each word of a text once; the context is its
    neighbours' hash where it first stands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters.value)
        for batch in batches:
            for row, toxic, text in zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                words, seen = restorer.words(text), {}
                for i, w in enumerate(words):
                    if w not in seen and 1 < len(w) <= MEMO_CHARS:
                        seen[w] = zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode("utf-8", "surrogatepass"))
                n = len(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([toxic] * n, pa.int32()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["doc_id", "toxic", "word", "context"]
                )

    return task


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fit to ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    The language model counts all of ``docs``.  The weights learn from ``max_docs`` labelled rows of each
    class at most, those with the least hashes.  A row with several labels is toxic if one says so; null
    labels and ids teach nothing.  Without toxic or without other rows no word has a weight.
    """
    with scratch():
        return _fitted(docs, labels, max_docs)


def _fitted(docs: DataFrame, labels: DataFrame, max_docs: int) -> Model:
    spark = docs.sparkSession
    letters = language_model(docs)
    shared = spark.sparkContext.broadcast(letters)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for t in (0, 1)]
    chosen = stored(some[0].unionAll(some[1]), "toxic-chosen")  # 2 * max_docs rows of two numbers at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    said = stored(rows.select("doc_id", "toxic", "text").mapInArrow(_evidence(shared), "doc_id long, toxic int, word string, context long"), "toxic-words")
    size = {r["toxic"]: r["n"] for r in said.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return Model(letters)
    # copies of one text have the same neighbours: they are one support
    counts = said.groupBy("word", "toxic").agg(F.count_distinct("context").alias("n")).groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("k1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("k0")
    )
    share = n1 / (n0 + n1)
    both = F.col("k0") + F.col("k1")
    sigmas = (F.col("k1") - share * both) / F.sqrt(share * (1 - share) * both)
    chosen_words = counts.filter((F.col("k1") >= MIN_SUPPORT) & (sigmas > MIN_SIGMAS)).withColumn("s", sigmas).orderBy(F.desc("s"), "word").limit(MAX_WORDS)
    words = stored(chosen_words, "toxic-weights")
    found = {r["word"]: (r["k1"], r["k0"]) for r in words.collect()}
    weight = lambda k1, k0: float(np.log((k1 + 0.5) / (n1 + 1)) - np.log((k0 + 0.5) / (n0 + 1)))
    weights = {w: weight(*k) for w, k in found.items()}
    # each row without its own share in the weights
    alone = {w: weight(k1 - 1, k0) if k1 - 1 >= MIN_SUPPORT else 0.0 for w, (k1, k0) in found.items()}
    table = spark.createDataFrame([(w, weights[w], alone[w]) for w in weights] or [("", 0.0, 0.0)], "word string, w double, a double")
    sums = said.join(F.broadcast(table), "word").groupBy("doc_id", "toxic").agg(F.sum(F.when(F.col("toxic") == 1, F.col("a")).otherwise(F.col("w"))).alias("total")).collect()
    x = np.array([r["total"] for r in sums])
    y = np.array([r["toxic"] for r in sums])
    rest = np.array([n0 - int((y == 0).sum()), n1 - int((y == 1).sum())])
    slope, offset = _logistic(np.concatenate([x, [0.0, 0.0]]), np.concatenate([y, [0, 1]]), np.concatenate([np.ones(len(x)), rest]))
    return Model(letters, weights, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of P(y = 1 | x) over rows that count ``n`` times, by Newton's method; the slope is
    held to a small prior, so that classes that do not overlap have a finite one."""
    design, theta, prior = np.stack([x, np.ones(len(x))], axis=1), np.zeros(2), np.array([0.1, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -500, 500)))
        gradient = design.T @ (n * (y - p)) - prior * theta
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.diag(prior), gradient)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(theta[0])), float(theta[1])


def _scores(model) -> Column:
    @F.arrow_udf("struct<score:double,hits:int>")
    def scores(text: pa.Array) -> pa.Array:
        m = model.value
        restorer = _restorer(model)
        total, hits = np.zeros(len(text)), np.zeros(len(text), np.int32)
        for i, t in enumerate(text.to_pylist()):
            found = m.weights.keys() & set(restorer.words(t))
            total[i], hits[i] = sum(m.weights[w] for w in sorted(found)), len(found)
        return pa.StructArray.from_arrays([pa.array(m.score(total)), pa.array(hits)], ["score", "hits"])

    return scores(F.col("text"))


_restorers: dict[int, Restorer] = {}


def _restorer(shared) -> Restorer:
    """Of a broadcast model; a worker keeps the latest one's, with its memo."""
    if id(shared.value) not in _restorers:
        _restorers.clear()
        _restorers[id(shared.value)] = Restorer(shared.value.letters)
    return _restorers[id(shared.value)]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on) and n_hits, the weighted words found, for each row.

    Only the text counts; a null text is scored as an empty one, equal texts alike, long ones whole.
    An empty table gives no rows; other columns are not read.
    """
    found = docs.select("doc_id", "text").withColumn("s", _scores(docs.sparkSession.sparkContext.broadcast(model)))
    return found.select("doc_id", F.col("s.score").alias("score"), (F.col("s.score") >= threshold).cast("int").alias("predicted"), F.col("s.hits").alias("n_hits"))
