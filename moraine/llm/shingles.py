"""Hashes of words and of 5-word shingles for Arrow batches of texts, in numpy.

A word is a run of other than ASCII white space, with A-Z lower-cased.  Word hashes are differences
of one running polynomial over the bytes, shingle hashes mix those of their words; both are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer word extends its block.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240607)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _rng.integers(0, (1 << 64) - 1, 256, dtype=np.uint64, endpoint=True)[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if not _POW or len(_POW[0]) < n:
        _POW[:] = [_powers(_R, n), _powers(_R_INV, n)]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column in a row and the offsets of its texts; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (and the end)."""
    n = len(data)
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[offsets] = True
    hashes, places = [], []
    at = 0
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and not breaks[end] and not _SPACE[data[end - 1]]:
            step = min(n, end + 4096)
            stop = np.flatnonzero(_SPACE[data[end:step]] | breaks[end:step])
            end = end + int(stop[0]) if len(stop) else step
            if len(stop):
                break
        part = data[at:end]
        space = _SPACE[part]
        first = ~space
        first[1:] &= space[:-1] | breaks[at + 1 : end]
        last = ~space
        last[:-1] &= space[1:] | breaks[at + 1 : end]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(max(len(part), BLOCK))
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64)))
        hashes.append(mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        places.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; fewer than ``size`` words give none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mix(total + words[k : k + n])
    return total


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted int64 hashes; see :mod:`.neardup` for short texts."""
    data, offsets = text_bytes(column)
    words, firsts = word_hashes(data, offsets)
    every = shingle_hashes(words, size).view(np.int64)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1])
        else:
            yield shingle_hashes(words[a:b], b - a).view(np.int64) if b > a else np.zeros(0, np.int64)
