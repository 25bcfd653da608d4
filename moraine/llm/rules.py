"""Quality rules: a ledger of failure bits and measurements, policies and ablations on it.

Each rule is evaluated once for each document.  What it measured and whether it failed (bit ``b``
of ``fail_bits``) are kept, so that a policy, which is only a mask of bits, can be applied, changed
or taken apart without reading a text again.  All of it is built-in Spark expressions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, made, stored, words_of

WINDOW = 8
#: Goes up when a measurement comes to mean something else: ledgers kept before are not found then.
MEASURES = 1


@dataclass(frozen=True)
class Rule:
    """``bit`` is a rule's place in the ledger for ever; retired bits are not given out again."""

    bit: int
    name: str
    fails: Column


def _rules() -> list[Rule]:
    n = F.col("n_words")
    return [
        Rule(0, "few_words", n < 20),
        Rule(1, "repeated_windows", 100 * F.col("n_repeat_words") > 30 * n),
        Rule(2, "symbols", 100 * F.col("n_symbols") > 20 * n),
        Rule(3, "capitals", 100 * F.col("n_capitals") > 40 * F.col("word_chars")),
        Rule(4, "stutter", 100 * F.col("n_stutter") > 30 * n),
        Rule(5, "repeated_lines", 100 * F.col("n_dup_lines") > 60 * F.col("n_lines")),
        Rule(6, "word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
    ]


def mask_of(*names: str) -> int:
    known = {r.name: r.bit for r in _rules()}
    return sum(1 << known[x] for x in names)


#: Versioned policies: a document is kept if it fails none of these rules.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "capitals", "stutter", "repeated_lines", "word_length"),
}


def _pairs(values: Column, n: Column, step: int, f) -> Column:
    """``f`` of each element and the one ``step`` places on; ``n`` is the length of ``values``."""
    return F.zip_with(F.slice(values, F.lit(1), n - step), F.slice(values, F.lit(step + 1), n - step), f)


def _covered(hashes: Column) -> Column:
    """Words that lie in the windows whose hash occurs again, from the hash of each window."""
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        same = lambda x, k: x["h"].eqNullSafe(F.get(s, k)["h"])
        return F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))

    def total(at: Column) -> Column:
        gaps = _pairs(at, F.size(at), 1, lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long"))
        return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)

    return let(placed, lambda s: let(F.sort_array(F.array_compact(again(s))), total))


def _window_hashes(h: Column, n: Column) -> Column:
    """From the hashes of ``n`` words, at least 8: the hash of each 8-word window, by doubling."""
    mix = F.xxhash64
    two = lambda a, b: mix(a, b)
    return let(_pairs(h, n, 1, two), lambda h2: let(_pairs(h2, n - 1, 2, two), lambda h4: _pairs(h4, n - 3, 4, two)))


def _of_words(w: Column) -> Column:
    """What is counted on the list of words: a struct."""

    def counts(h: Column) -> Column:
        n = F.size(h)
        repeated = let(
            _window_hashes(h, n),
            lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(g)).otherwise(F.lit(0).cast("long")),
        )
        same = F.when(n > 1, F.size(F.filter(_pairs(h, n, 1, lambda a, b: a == b), lambda x: x))).otherwise(0)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(n > WINDOW, repeated).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
            same.cast("long").alias("n_stutter"),
        )

    return let(F.transform(w, lambda x: F.xxhash64(x)), counts)


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements, each a long:

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_capitals, n_lines
    (lines with a word), n_dup_lines (of those, equal to an earlier one), n_repeat_words (words in
    8-word windows that occur again in the text), n_stutter (words equal to the word before).

    A null or empty text measures 0 everywhere.  Windows are compared by a 64-bit hash within one
    document: for a document of a million words the odds of a false match are 3e-8.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda keep: F.length(F.regexp_replace(text, keep, "")).cast("long")
    words = words_of(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    measured = docs.withColumns(
        {
            "_w": let(words, _of_words),
            "_l": line_counts,
            "n_symbols": only(r"[^#*$%&|<>]+"),
            "n_capitals": only(r"\P{Lu}+"),
        }
    )
    names = ("n_words", "word_chars", "n_repeat_words", "n_stutter")
    return measured.withColumns({x: F.col(f"_w.{x}") for x in names} | {"n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.dup")}).drop("_w", "_l")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: one row a document, no text.

    A null measurement can't occur, so each bit is defined; repeated rows give repeated rows.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")
    keep = [x for x in ("doc_id", "source") if x in docs.columns]
    led = measure(docs.select(*keep, "text")).select(*keep, *names).withColumn("fail_bits", F.lit(0).cast("long"))
    for r in _rules():
        led = with_rule(led, r)
    return led


def with_rule(led: DataFrame, rule: Rule) -> DataFrame:
    """``led`` with the bit of ``rule`` set from the measurements, and no other changed: a rule that is
    new, or has a new limit, costs no reading of texts.  Where ``fails`` is null the bit is 0."""
    others = F.col("fail_bits").bitwiseAND(F.bitwise_not(F.lit(1 << rule.bit).cast("long")))
    return led.withColumn("fail_bits", others.bitwiseOR(F.when(rule.fails, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")))


def ledger_key(docs: DataFrame) -> str:
    """Names the ledger of ``docs``, a table as it was read from files: the files' paths, sizes and
    times with the rules and what they measure.  A file without rows adds nothing to a ledger."""
    files = docs.select(*(f"_metadata.{x}" for x in ("file_path", "file_size", "file_modification_time"))).distinct()
    marks = (F.bit_xor(F.xxhash64(F.lit(salt), *files.columns)) for salt in (1, 2))
    found = files.agg(F.count(F.lit(1)), *marks).first()
    said = [(r.bit, r.name, str(r.fails)) for r in _rules()]
    return hashlib.sha256(repr((MEASURES, said, tuple(found))).encode()).hexdigest()[:32]


def keep_ledger(docs: DataFrame) -> DataFrame:
    """Evaluate the rules on all of ``docs`` (read from files) and keep the ledger in the shared folder,
    where ``kept_ledger`` finds it for as long as the files and the rules stay as they are."""
    return stored(ledger(docs), f"ledger-{ledger_key(docs)}")


def kept_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of ``docs`` that was kept, and evaluated now only where there is none.

    Only a ledger that was written to its end counts, so a writer that died or is not done is passed
    over; of two that were written at once either serves."""
    paths = made(docs.sparkSession, f"ledger-{ledger_key(docs)}")
    if not paths:
        return keep_ledger(docs)
    return docs.sparkSession.read.schema(ledger(docs).schema).parquet(paths[0])


def fails(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(led: DataFrame, policy: str = "v1") -> DataFrame:
    """``led`` with ``kept``: true where no rule of the policy failed."""
    return led.withColumn("kept", ~fails(F.col("fail_bits"), mask_of(*POLICIES[policy])))


def ablations(led: DataFrame, policy: str = "v1", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each rule of ``policy`` (and group of ``by``): documents that fail it, that fail
    it alone, and that would be kept without it.

    Documents are first counted by their bits (at most 2**rules rows a group), then the counts
    are added up under each mask; no text or document is read twice.
    """
    counts = led.groupBy(*by, "fail_bits").agg(F.count(F.lit(1)).alias("_n"))
    whole = mask_of(*POLICIES[policy])
    rules = [F.struct(F.lit(x).alias("rule"), F.lit(mask_of(x)).cast("long").alias("mask")) for x in POLICIES[policy]]
    left = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    return (
        counts.withColumn("_r", F.explode(F.array(*rules)))
        .groupBy(*by, F.col("_r.rule").alias("rule"))
        .agg(
            total(left.bitwiseAND(F.col("_r.mask")) != 0).alias("n_failed"),
            total(left == F.col("_r.mask")).alias("n_failed_alone"),
            total(left.bitwiseAND(F.bitwise_not(F.col("_r.mask"))) == 0).alias("n_kept_without"),
            total(left == 0).alias("n_kept"),
        )
    )
