"""Vector codes against brute force in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from moraine.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, n_rows long"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of rows (vec_id, embedding, label), and the digest of the codebooks."""
    good = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for _, v, _ in good[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda a, book: min((far(a, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in good:
                of.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])]
    out, total = [], {}
    for i, v, label in good:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        total[label] = total.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label]) for i, c, e, label in out), key=str), sha


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    found, books = codes.compress(df)
    got = sorted(((r["id"], r["code"], r["error"], r["label_error"]) for r in found.collect()), key=str)
    assert (got, codes.digest(books)) == brute(rows)


@pytest.mark.parametrize("width", [1, 3, 8])
def test_codes_against_brute_force(spark, width):
    rng = random.Random(width)
    centres = [[rng.gauss(0, 0.3) for _ in range(8 * width)] for _ in range(5)]
    rows = [(i, [rng.gauss(c, 0.05) for c in rng.choice(centres)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 3) for i in range(150)]  # a third of all are copies
    rows += [(2000, None, 1), (2001, [math.nan] * 8 * width, 1), (2002, [None] + [0.0] * (8 * width - 1), 1), (2003, [math.inf] * 8 * width, 2), (-5, [0.0] * 8 * width, None), (None, rows[3][1], 2)]
    rows += rows[:2]
    check(spark, rows)


def test_few_and_large_and_equal_vectors(spark):
    check(spark, [(i, [float(i)] * 8, 1) for i in range(3)])
    check(spark, [(i, [1.5] * 16, None) for i in range(40)])  # ties go to the first entry
    check(spark, [(i, [(-1.0) ** i * 3e5 * (i % 7)] * 8, i % 2) for i in range(40)])  # squares of 2^60 and more


def test_odd_tables(spark):
    none, books = codes.compress(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and books is None and codes.digest(None) == hashlib.sha256(b"").hexdigest()
    rows = [(i, [float(i)] * 8, 1) for i in range(20)] + [(50, [1.0] * 16, 1), (51, [1.0], 1), (-1, [2.0], 1), (60, [], 1)]
    found = {r["id"]: (r["code"], r["error"]) for r in codes.compress(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA))[0].collect()}
    assert len(found) == 24 and {k for k, v in found.items() if v == (None, None)} == {50, 51, -1, 60}
    # errors beyond a long are its largest value
    huge = spark.createDataFrame([(i, [1e11 * (i % 3) * (i * i + 1)] * 8, 1, "x", 1, 2) for i in range(30)], SCHEMA)
    assert max(r["label_error"] for r in codes.compress(huge)[0].collect()) == 2**63 - 1


def test_cells_leave_out_only_entries_that_cannot_be_nearest(monkeypatch):
    rng = np.random.default_rng(5)
    book, points = rng.integers(-4000, 4000, (16, 8)), rng.integers(-5000, 5000, (4000, 8))
    book[9] = book[2]
    want = ((points[:, None, :] - book) ** 2).sum(axis=2)
    monkeypatch.setattr(codes, "MEMO_CELLS", 500)  # the memo is emptied again and again
    cells = codes.Cells(book)
    for at in range(0, 4000, 400):
        index, distance = cells.nearest(points[at : at + 400])
        assert (index == want[at : at + 400].argmin(axis=1)).all() and (distance == want[at : at + 400].min(axis=1)).all()
        assert len(cells.keys) <= 500
    # cells of one hash are told apart
    monkeypatch.setattr(codes, "_MULTIPLIER", np.uint64(0))
    index, _ = codes.Cells(book).nearest(points)
    assert (index == want.argmin(axis=1)).all()
    # far from all entries but one, few are compared
    tight = codes.Cells(np.array([[0] * 8, [100] * 8, [9000] * 8]))
    assert tight.candidates(np.array([[9000 >> tight.shift] * 8])).sum() == 1
