"""Toxicity: the parts against brute force, planted disguises, held-out accuracy, odd rows."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import toxicity

SYLLABLES = ["ba", "den", "ri", "mo", "lus", "ket", "an", "vo", "sil", "per", "tan", "go", "hem", "ul"]
LEXICON = ["gorlak", "vinterex", "snodding", "pelmurk", "drazzit"]


def say(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def letters():
    rng = random.Random(2)
    total = sum(toxicity.trigrams([say(rng, 3000) + " " + " ".join(LEXICON)]) for _ in range(4)).reshape((toxicity.SYMBOLS,) * 3)
    return np.log((total + 0.01) / (total.sum(axis=2, keepdims=True) + 0.64)).astype(np.float32)


def test_trigrams_against_brute_force():
    texts = ["Ab, cd", None, "", "é漢 x9y", "a" * 5, "1 2  3"]
    want = Counter()
    for t in texts:
        s = [0, 0]
        for c in (t or "").lower():
            x = toxicity._symbol(c) if c.isalpha() else 0
            if x or s[-1] or s[-2]:
                s.append(x)
        s += [0] * (2 - (not s[-1]) - (not s[-1] and not s[-2])) if len(s) > 2 else []
        want.update(zip(s, s[1:], s[2:]))
    got = toxicity.trigrams(texts).reshape((toxicity.SYMBOLS,) * 3)
    found = {tuple(map(int, k)): int(got[tuple(k)]) for k in np.argwhere(got) if k.any()}
    assert found == {k: v for k, v in want.items() if any(k)}


def test_viterbi_against_all_paths(letters):
    rng = random.Random(4)

    def cost(text, price):
        s = [0, 0]
        for c in [*text, " "]:
            x = 0 if c == " " else toxicity._symbol(c)
            if x or s[-1]:
                price -= letters[s[-2], s[-1], x]
                s.append(x)
        return price

    for _ in range(150):
        stretch, apart = "".join(rng.choice("abmo01!|@.-  $") for _ in range(rng.randrange(1, 8))), rng.random() < 0.5
        places = toxicity.lattice(stretch, apart)
        every = [cost("".join(t for t, _ in path), sum(p for _, p in path)) for path in itertools.product(*places)]
        best = toxicity.viterbi(places, letters)
        mine = [sum(p for _, p in path) for path in itertools.product(*places) if "".join(t for t, _ in path) == best]
        assert cost(best, min(mine)) == pytest.approx(min(every), abs=1e-3), stretch


def plain_stretches(low):
    """The definition, token by token."""
    likes, marks, edge = set(toxicity.LOOK_ALIKES), set(toxicity.MARKS), set(toxicity._EDGE)
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", low)]
    one = lambda s, e: e - s == 1 and (low[s].isalpha() or low[s] in likes)
    out, k = [], 0
    while k < len(tokens):
        n = k
        while n < len(tokens) and one(*tokens[n]):
            n += 1
        if n - k >= 3:
            out.append((tokens[k][0], tokens[n - 1][1], True))
            k = n
            continue
        for s, e in tokens[k : max(n, k + 1)]:
            t = low[s:e]
            kind = "".join("a" if c.isalpha() and c not in likes else "l" if c in likes else "m" if c in marks else "o" for c in t)
            if re.search(r"a[lm]+a|^[lm]*l(?=a)", kind) or re.search(r"([^\W\d_])\1\1", t):
                while e > s and low[e - 1] in edge:
                    e -= 1
                while s < e and low[s] in edge and low[s] not in likes:
                    s += 1
                out.append((s, e, False))
        k = max(n, k + 1)
    return [x for x in out if x[0] < x[1]]


def test_stretches_against_a_plain_scan():
    rng = random.Random(9)
    for text in ["", "a", "i d i o t", "a b", "x 1 y z", "..a b c", "a\nb\nc d", "(m0r0n!!)", "-ab", "1ab", "don't", "aaab 77 !!! a.b.c.", *("".join(rng.choice("ab1!.- \n(é") for _ in range(rng.randrange(1, 30))) for _ in range(4000))]:
        assert list(toxicity.Restorer._stretches(text)) == plain_stretches(text), text


def disguise(rng, word):
    how = rng.randrange(4)
    if how == 0:
        return " ".join(word)
    if how == 1:
        return rng.choice(".-_*").join(word)
    if how == 2:
        at = rng.randrange(len(word))
        return word[:at] + word[at] * rng.randrange(3, 8) + word[at + 1 :]
    back = {"a": "4@", "e": "3", "i": "1!", "o": "0", "s": "5$", "t": "7", "l": "1|"}
    return "".join(rng.choice(back[c]) if c in back and 0 < k else c for k, c in enumerate(word))


def test_disguised_words_are_restored(letters):
    rng, restorer = random.Random(6), toxicity.Restorer(letters)
    cases = [(w, disguise(rng, w)) for w in LEXICON * 30]
    found = sum(w in restorer.words(f"{say(rng, 5)} {x} {say(rng, 5)}") for w, x in cases)
    assert found >= 0.9 * len(cases), [(w, x, restorer.words(x)) for w, x in cases if w not in restorer.words(x)][:5]
    # text that is not disguised stays as it is
    for _ in range(50):
        t = say(rng, 30)
        assert restorer.words(t.upper() + "!!") == t.split()
    assert restorer.words(None) == restorer.words("") == restorer.words(" 12 !! ") == []
    # linear in the length, in bounded memory
    long = " ".join("gorlak") + " x1y " * 20000 + "a " * 20000 + "é1" * 20000
    assert "gorlak" in restorer.words(long) and len(restorer.memo) < 1000


SCHEMA = "doc_id long, text string, lang string, score int, toxic string, s string, word int"


def corpus(rng, n):
    """(doc_id, text, toxic): a third toxic, half of these disguised; a hot group of toxic copies."""
    rows = []
    for i in range(n):
        words = say(rng, rng.randrange(20, 60)).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                w = rng.choice(LEXICON)
                words.insert(rng.randrange(len(words)), disguise(rng, w) if i % 2 else w)
        rows.append((i, " ".join(words), int(toxic)))
    copied = say(rng, 30) + " gorlak"
    return rows + [(n + i, copied, 1) for i in range(n // 4)]


@pytest.fixture(scope="module")
def planted(spark):
    rows = corpus(random.Random(12), 600)
    docs = spark.createDataFrame([(i, t, "en", 1, "x", "y", 0) for i, t, _ in rows] + [(9001, None, None, None, None, None, None), (9002, "", "en", 1, "x", "y", 0), (None, "gorlak", "en", 1, "x", "y", 0), (0, rows[0][1], "en", 1, "x", "y", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (9001, 0, None), (9002, None, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(planted):
    rows, docs, labels = planted
    model = toxicity.train(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    assert set(LEXICON) <= set(model.weights) and min(model.weights[w] for w in LEXICON) > 1
    # the other words of the copied text have one support, however often it is copied
    assert len(model.weights) < len(LEXICON) + 8
    got = {(r["doc_id"]): r for r in toxicity.score(docs, model).collect()}
    right = [(got[i]["predicted"], y) for i, _, y in rows]
    hits = sum(p and y for p, y in right)
    assert hits >= 0.9 * sum(y for _, y in right) and sum(p for p, _ in right) <= 1.03 * hits
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[9001]["score"] == got[9002]["score"] and got[9001]["predicted"] == 0 and got[None]["predicted"] == 1
    assert toxicity.score(docs, model).count() == len(rows) + 4


def test_weights_against_brute_force(planted, letters):
    rows, docs, labels = planted
    model = toxicity.train(docs, labels)
    restorer, said = toxicity.Restorer(model.letters), {0: {}, 1: {}}
    for i, t, y in rows:
        words = restorer.words(t)
        for k, w in enumerate(words):
            if words.index(w) == k and len(w) > 1:
                said[y].setdefault(w, set()).add((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
    n0, n1 = sum(y == 0 for _, _, y in rows) + 0, sum(y for _, _, y in rows)
    for w, found in model.weights.items():
        k1, k0 = len(said[1][w]), len(said[0].get(w, ()))
        assert found == pytest.approx(np.log((k1 + 0.5) / (n1 + 1) * (n0 + 1) / (k0 + 0.5)), abs=1e-6), w


def test_bound_and_missing_labels(spark, planted):
    _, docs, labels = planted
    assert len(toxicity.train(docs, labels, max_docs=20).weights) <= len(toxicity.train(docs, labels).weights)
    empty = spark.createDataFrame([], SCHEMA)
    for some in (labels.filter("false"), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        model = toxicity.train(docs, some)
        assert not model.weights and toxicity.score(docs, model).filter("predicted = 1").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_query(spark):
    from moraine.llm import queries

    got = queries.op11_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    held = got.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in held}
    assert n.get((0, 1), 0) <= 1 and n.get((1, 1), 0) >= 0.6 * (n.get((1, 0), 0) + n.get((1, 1), 0))
