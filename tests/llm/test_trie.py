"""The prefix trie against brute force over whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from moraine.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, a long, shard int, d string, words int"


def brute(rows):
    """{(conv_id, depth): the rest of a node's row} of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        ends[tuple(built)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += children[p] == 0
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode().split())
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return {(m[0], len(p)): (members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items()}


def found(df):
    rows = df.collect()
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    say = lambda: " ".join(rng.choice(["yes", "no", "maybe", "why"]) for _ in range(rng.randrange(1, 3)))
    out = []
    for c in [*range(0, 130), -3, -20, -25, 1000, 2001]:
        if c == 40:
            continue  # a family without its first conversation
        out += [(c, t, rng.choice(["user", "user", "assistant", None]), rng.choice([say(), say(), None, ""])) for t in range(rng.choice([0, 1, 2, 4, 7, 11]))]
    hot = [("user", "hello there you"), ("assistant", "hi"), ("user", "tell me more now")]
    out += [(c, t, r, x) for c in range(3000, 3400) if c != 3100 for t, (r, x) in enumerate(hot)]  # copies
    out += [(c, t, "user", "one two" if t < 3 else say()) for c in range(3400, 3460) for t in range(6)]  # one first turn
    out += [(5000, t, "user", f"w{t % 5}") for t in range(700)]  # a long one, and one that goes along
    out += [(5020, t, "user", f"w{t % 5}") for t in range(300)]
    out += [(7, None, "system", "null turn"), (7, None, None, "another"), (None, 1, "user", "no conversation")]
    out += [out[5], out[5]]
    rng.shuffle(out)
    return [r for i, r in enumerate(out)]


def unique_ties(rows):
    """Without rows that tie in their turn but are not equal in role: these the brute force orders by text."""
    seen, out = {}, []
    for r in rows:
        if seen.setdefault(r[:2] + (r[2] or "",), r) == r:
            out.append(r)
    return out


@pytest.mark.parametrize(("shard", "above"), [(None, 1 << 20), (50, 1 << 20), (50, 0)])
def test_trie_against_brute_force(spark, rows, shard, above, monkeypatch):
    monkeypatch.setattr(trie, "MAX_ABOVE", above)
    if not above:
        rows = [r for r in rows if r[0] is None or r[0] < 5000]  # one job a level
    rows = unique_ties(rows)
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA).repartition(5)
    assert found(trie.prefix_trie(df, shard)) == brute(rows)


def test_few_and_no_conversations(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)
    assert found(trie.prefix_trie(frame([]))) == {} == found(trie.prefix_trie(frame([(None, 1, "user", "x")])))
    for rows in ([(1, 1, "user", "a b")], [(20, 0, None, None), (21, 0, "", "")], [(3, 1, "u", "x"), (3, 1, "u", "x")]):
        assert found(trie.prefix_trie(frame(rows))) == brute(rows)


def test_slots_are_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rng.integers(-(2**63), 2**63, n), rng.integers(0, 3, n)
        a[: n // 2] = a[0] if n else 0
        b[: n // 2] = np.arange(n // 2)
        slots = trie.Slots(a, b)
        assert sorted(slots(a, b).tolist()) == list(range(n))
    with pytest.raises(ValueError, match="equal digests"):
        trie.Slots(np.array([5, 5]), np.array([1, 1]))


def test_ids_of_ends_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)
    rows = [(a, 0, c) for a in (1, 2) for c in range(a, 300, a)]
    got = {r["a"]: r["ends_sha256"] for r in trie._ends(spark.createDataFrame(rows, "a long, b long, c long").repartition(4)).collect()}
    assert got == {a: hashlib.sha256(",".join(str(c) for c in range(a, 300, a)).encode()).hexdigest() for a in (1, 2)}
