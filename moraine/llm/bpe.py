"""Byte-level BPE as a streaming transducer, and its inverse as a byte-to-text state machine.

How a token sequence is known to be the encoding.  Merges are applied by rank, and each token has
one derivation.  ``t1 .. tn`` is the encoding of its bytes exactly if each neighbouring pair is
(``Merges.fits``): no merge across their border comes before the merges that made the two sides.
So the last token of the encoding of each prefix follows from the last tokens of shorter ones, byte
by byte; the encodings of all prefixes form a tree.  Whatever follows, later tokens attach to one of
the last ``longest`` prefixes: what these have in common is stable and can be emitted.

``Merges.lookahead`` is computed from the merge list: the greatest number of bytes over which a
change at the right end can travel left, by a chain of merges of rising rank each of which takes the
left part of the one before.  The transducer looks for stable tokens whenever it holds more than
that, so it holds at most about twice as many bytes, however long the text is.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the pattern of the public tokenizer that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are split and encoded at once, and of a run without a safe border.
BLOCK, SLICE = 1 << 16, 1 << 12
SHORT = (2, 1)
#: Bytes of a piece that the transducer takes at once.
PART = 256
#: Bytes of an encoder's memo, whatever it has read, with ENTRY for what a dictionary takes for one
#: stretch; and pairs of tokens known to fit or not (about 130 bytes each).
MEMO_BYTES, ENTRY, MEMO_PAIRS = 96 << 20, 260, 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(more)
            more += 1
    return [symbols[b] for b in range(256)]


class Merges:
    """Vocabulary and merge list of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        back = {s: b for b, s in enumerate(byte_symbols())}
        vocab = file["model"]["vocab"]
        self.id_of = {bytes(back[c] for c in token): i for token, i in vocab.items()}
        self.specials = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for content, i in self.specials.items():
            self.bytes_of[i] = content.encode()
        self.longest = max(map(len, self.id_of))
        self.rank: dict[tuple[int, int], int] = {}
        #: of a token: rank of the merge that makes it, its parts (-1 and itself for a byte)
        self.made = [-1] * len(self.bytes_of)
        self.left, self.right = list(range(len(self.bytes_of))), list(range(len(self.bytes_of)))
        for k, pair in enumerate(file["model"]["merges"]):
            a, b = (self.id_of[bytes(back[c] for c in x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            t = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = k
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = k, a, b
        # a token that its own bytes don't encode to never occurs
        self.whole = [True] * len(self.bytes_of)
        for t in sorted(range(len(self.bytes_of)), key=self.made.__getitem__):
            if self.made[t] >= 0:
                a, b = self.left[t], self.right[t]
                self.whole[t] = self.whole[a] and self.whole[b] and self.fits(a, b, self.made[t])
        self.id_of = {token: i for token, i in self.id_of.items() if self.whole[i]}
        tails: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        #: lengths over 2 of the tokens that end in three bytes, the longest first
        self.lengths = {t: (*sorted(n, reverse=True), 2, 1) for t, n in tails.items()}
        self.memo: dict[int, bool] = {}

    def fits(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes first (and before ``before``).

        Walks back in time: of the two tokens at the border, the one made later is taken apart.
        Of equal merges the left one is made first.
        """
        rank, made = self.rank, self.made
        until_a = until_b = before
        while True:
            k = rank.get((a, b))
            if k is not None and k < until_a and k <= until_b and k < before:
                return False
            if made[a] > made[b]:
                until_a, a = made[a], self.right[a]
            elif made[b] >= 0:
                until_b, b = made[b], self.left[b]
            else:
                return True

    @property
    def lookahead(self) -> int:
        """Bytes to the right of a border after which nothing that follows can move it."""
        if not hasattr(self, "_lookahead"):
            reach: dict[int, int] = {}  # of a token at the border: by merges of higher rank that take it
            most = 0
            for (a, b), _ in sorted(self.rank.items(), key=lambda x: -x[1]):
                size = len(self.bytes_of[b]) + max(len(self.bytes_of[a]), reach.get(a, 0))
                reach[b] = max(reach.get(b, 0), size)
                most = max(most, size)
            self._lookahead = most + self.longest
        return self._lookahead


class Transducer:
    """Encodes one piece of text, fed in parts of any size."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.data = bytearray()
        self.last: list[int] = [-1]  # last token of the encoding of each prefix of data

    def _extend(self) -> None:
        """Find the last token of each new prefix of ``data``: the longest that fits what it follows."""
        m, last, text = self.m, self.last, bytes(self.data)
        id_of, lengths, memo, fits = m.id_of.get, m.lengths.get, m.memo, m.fits
        for end in range(len(last), len(text) + 1):
            for n in lengths(text[end - 3 : end] if end > 2 else b"", SHORT):
                if n > end:
                    continue
                token = id_of(text[end - n : end])
                if token is None:
                    continue
                before = last[end - n]
                if before < 0:
                    if end == n:
                        last.append(token)
                        break
                    continue
                key = before << 32 | token
                fit = memo.get(key)
                if fit is None:
                    if len(memo) >= MEMO_PAIRS:
                        memo.clear()
                    fit = memo[key] = fits(before, token)
                if fit:
                    last.append(token)
                    break
            else:
                raise AssertionError("no token fits")

    def _path(self, end: int) -> list[int]:
        tokens = []
        while end > 0:
            tokens.append(self.last[end])
            end -= len(self.m.bytes_of[self.last[end]])
        return tokens[::-1]

    def feed(self, data: bytes) -> list[int]:
        """Take more bytes; the tokens that are stable now and were not returned yet."""
        self.data += data
        self._extend()
        if len(self.data) <= self.m.lookahead + self.m.longest:
            return []
        ends = {*range(len(self.data) - self.m.longest + 1, len(self.data) + 1)}
        while len(ends) > 1:
            end = max(ends)
            ends.discard(end)
            ends.add(end - len(self.m.bytes_of[self.last[end]]))
        cut = ends.pop()
        tokens = self._path(cut)
        if tokens:
            # what went out stays as the token that the next ones must fit
            keep = tokens[-1]
            self.data = self.data[cut:]
            self.last = [keep, *self.last[cut + 1 :]]
        return tokens

    def finish(self) -> list[int]:
        tokens = self._path(len(self.data))
        self.data, self.last = bytearray(), [-1]
        return tokens


def encode_piece(transducer: Transducer, data: bytes) -> list[int]:
    """Ids of a whole piece: fed part by part, each token taken as soon as it is stable."""
    tokens: list[int] = []
    for i in range(0, len(data), PART):
        tokens += transducer.feed(data[i : i + PART])
    return tokens + transducer.finish()


#: White space but space and line end, and pairs that have such or a mark out of place.
RARE_ASCII = "\t\v\f\r\x1c\x1d\x1e\x1f"
RARE = RARE_ASCII + "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_PAIRS = ("  ", " \n", "\n ", "\n\n", " .", " ,", "\n.", "\n,")
#: Marks that, between a letter or digit and white space, are a piece of their own.
MARKS = ".,"


class Encoder:
    """Text to packed ids.

    ``pieces_to_ids`` encodes pieces that PATTERN has split off, many at once.  Text is cut where a
    single space or line end stands between two other characters, and before a full stop or comma
    that follows a letter or digit and precedes white space: PATTERN always splits there.  What a
    stretch encodes to is kept in a memo of ``memo_bytes``; beyond that the last quarter goes,
    since what is frequent is met early.
    """

    def __init__(self, pieces_to_ids: Callable[[list[str]], Iterable[list[int]]], specials: dict[str, int], dtype: str, stream: Callable[[str], Iterator[list[int]]], memo_bytes: int = MEMO_BYTES):
        self.pieces_to_ids, self.specials, self.dtype, self.stream = pieces_to_ids, specials, dtype, stream
        self.memo_bytes = memo_bytes
        self.code = "H" if dtype == "<u2" else "I"
        self.split = regex.compile(PATTERN).findall
        #: by a stretch: of a space and it; of itself, where it follows a border without a space
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.held = 0  # bytes of both, about
        self.borders = re.compile(r"(?<=\S) (?=\S)")
        #: marks after a mark; it begins with them, so that the search skips all else
        self.marked = re.compile(r"[.,](?:(?<=[^\w\s][.,])(?=[ \n]|\Z)|(?<=_[.,]))").search
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _learn(self, words: list[str], memo: dict[str, bytes], lead: str) -> None:
        """Fill ``memo`` for the words that it lacks; after \\0 comes what no space precedes."""
        if self.held > self.memo_bytes:
            for some in (self.spaced, self.plain):
                for word in list(some)[3 * len(some) // 4 :]:
                    del some[word]
            self.held = sum(ENTRY + len(w) + len(p) for some in (self.spaced, self.plain) for w, p in some.items())
            if self.held > 7 * self.memo_bytes // 8:  # few, but long
                self.spaced.clear()
                self.plain.clear()
                self.held = 0
        texts = {w: lead + w if w[:1] != "\0" else w[1:] for w in words if w not in memo}
        parts = [[t] if t.isalpha() or t[:1] == " " and t[1:].isalpha() else self.split(t) for t in texts.values()]
        found = map(self.pack, self.pieces_to_ids([p for ps in parts for p in ps]))
        for w, ps in zip(texts, parts):
            memo[w] = next(found) if len(ps) == 1 else b"".join([next(found) for _ in ps])
            self.held += ENTRY + len(w) + len(memo[w])

    def _line(self, words: list[str], out: list[bytes]) -> None:
        """Append what the words of a stretch encode to: a space stands before all but the first."""
        if words[0]:  # else it begins at a border
            if words[0] not in self.plain:
                self._learn(words[:1], self.plain, "")
            out.append(self.plain[words[0]])
        del words[0]
        n = len(out)
        try:
            out.extend(map(self.spaced.__getitem__, words))
        except KeyError:
            del out[n:]
            self._learn(words, self.spaced, " ")
            out.extend(map(self.spaced.__getitem__, words))

    def _odd(self, text: str) -> bool:
        """Whether a space or line end has white space beside it, or a mark no letter or digit before it."""
        if any(x in text for x in ODD_PAIRS) or text[0] in "\n.," or text[-1] == "\n":
            return True
        return any(x in text for x in (RARE_ASCII if text.isascii() else RARE)) or bool(self.marked(text))

    def _block(self, text: str) -> bytes:
        out: list[bytes] = []
        if "\0" in text:  # the sign itself
            return b"".join(map(self.pack, self.pieces_to_ids(self.split(text))))
        if self._odd(text):
            self._line(self.borders.split(text), out)
            return b"".join(out)
        for mark in MARKS:
            text = text.replace(f"{mark} ", f" \0{mark} ").replace(f"{mark}\n", f" \0{mark}\n")
        if text[-1] in MARKS and len(text) > 1:
            text = f"{text[:-1]} \0{text[-1]}"
        for k, line in enumerate(text.split("\n")):
            if k:
                self._line(["\n"], out)
            self._line(line.split(" "), out)
        return b"".join(out)

    def _stretches(self, text: str) -> Iterator[str]:
        """The text in blocks that end at a border; longer ones only where there is no border."""
        at = 0
        while len(text) - at > BLOCK:
            end = at + BLOCK
            cut = text.rfind(" ", at + 1, end)
            while cut > at and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            if cut <= at:
                found = self.borders.search(text, end)
                cut = found.start() if found else len(text)
            yield text[at:cut]
            at = cut
        if at < len(text):
            yield text[at:]

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Packed ids of the text, block by block."""
        if not text:
            return
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.pack([self.specials[part]])
                continue
            for block in self._stretches(part):
                if len(block) > 2 * BLOCK:
                    for ids in self.stream(block):
                        yield self.pack(ids)
                else:
                    yield self._block(block)


_CLASSES = tuple(regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+"))


def stream_pieces(parts: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Pieces that PATTERN splits off a text which comes in parts: (characters, whether the piece ends).

    Three characters are held back: no piece that ends before them depends on what follows.  A
    piece longer than SLICE is handed on as it grows.
    """
    find = regex.compile(PATTERN).match
    held, grows = "", None  # grows: the class of characters of a piece that has begun to go out
    for part, final in _with_last(parts):
        held += part
        while held:
            if grows is not None:
                run = grows.match(held)
                end = run.end() if run else 0
                if end < len(held) or final:
                    if grows is _CLASSES[3] and end < len(held):
                        end -= 1  # the last white space goes with what follows
                    yield held[:end], True
                    held, grows = held[end:], None
                    continue
                if end > 3:
                    yield held[: end - 3], False
                    held = held[end - 3 :]
                break
            end = find(held).end()
            if final or end <= len(held) - 3:
                yield held[:end], True
                held = held[end:]
            elif len(held) > SLICE:
                grows = next(c for c in _CLASSES if c.match(held[1]))
                yield held[: len(held) - 3], False
                held = held[-3:]
            else:
                break


def _with_last(parts: Iterable[str]) -> Iterator[tuple[str, bool]]:
    before = None
    for part in parts:
        if before is not None:
            yield before, False
        before = part
    yield before or "", True


def encode_stream(merges: Merges, parts: Iterable[str]) -> Iterator[list[int]]:
    """Ids of a text that comes in parts, as soon as they are stable."""
    t = Transducer(merges)
    for piece, ends in stream_pieces(parts):
        yield t.feed(piece.encode("utf-8"))
        if ends:
            yield t.finish()


class Decoder:
    """Ids to text, in any portions: bytes that don't make a whole character yet are held."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, ids)), final)


@lru_cache(maxsize=2)
def merges_at(path: str) -> Merges:
    """One for each worker process."""
    return Merges(path)


def width(merges: Merges) -> str:
    return "<u2" if len(merges.bytes_of) <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def transducer_encoder(path: str) -> Encoder:
    m = merges_at(path)
    slices = lambda text: (text[i : i + SLICE] for i in range(0, len(text), SLICE))
    t = Transducer(m)
    return Encoder(lambda ps: (encode_piece(t, p.encode("utf-8")) for p in ps), m.specials, width(m), lambda text: encode_stream(m, slices(text)))


def round_trip(docs, path: str):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs`` (a DataFrame).

    The text is encoded block by block by the transducer and the ids go straight into the decoder;
    neither ids nor decoded text are held for longer than a block.  Null counts as empty: 0 tokens.
    ids_sha256 is over the ids as little-endian unsigned 32-bit integers.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        encoder, merges = transducer_encoder(path), merges_at(path)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text").to_pylist():
                n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges)
                for packed in encoder.encode(text):
                    ids = np.frombuffer(packed, dtype=encoder.dtype)
                    n += len(ids)
                    ids_sha.update(ids.astype("<u4").tobytes())
                    text_sha.update(decoder.feed(ids.tolist()).encode("utf-8"))
                text_sha.update(decoder.feed((), final=True).encode("utf-8"))
                counts.append(n)
                of_ids.append(ids_sha.hexdigest())
                of_text.append(text_sha.hexdigest())
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs, path: str):
    """doc_id and ``ids`` (array<int>) for each row; a null or empty text has no ids."""
    import pyarrow as pa

    def run(batches):
        encoder = transducer_encoder(path)
        for batch in batches:
            packed = [b"".join(encoder.encode(text)) for text in batch.column("text").to_pylist()]
            ids = [np.frombuffer(p, dtype=encoder.dtype) for p in packed]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, encoder.dtype)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded, path: str):
    """doc_id and ``text`` from doc_id and ``ids``; the inverse of :func:`encode_documents`."""
    import pyarrow as pa

    def run(batches):
        merges = merges_at(path)
        for batch in batches:
            texts = [Decoder(merges).feed(ids or (), final=True) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
