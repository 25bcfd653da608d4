"""PII: format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates are found by pattern, validated, and permuted within their own format: a card
number becomes another with a valid check digit, a date another date of the calendar, separators
and letter case stay.  The permutation depends on the key and kind alone, so equal values have equal
pseudonyms in every document, and different values different ones; with the key it can be undone.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
#: Dates are permuted among the days of these years.
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Kinds in the order in which they are tried at one place.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    ("date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<mark>[./])[0-9]{1,2}(?P=mark)[0-9]{4})(?![0-9/-]|\.[0-9])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9])(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone_int", r"(?<![0-9])\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,5}(?![0-9])"),
    ("card", r"(?<![A-Za-z0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![A-Za-z0-9])"),
)
KINDS = tuple(k for k, _ in PATTERNS)
#: The longest text that the IBAN pattern takes: 4 characters, 7 times a space and 4, a space and 3.
REACH = 43
#: Digits or letters that are permuted as one number; longer runs go in chunks of so many.
CHUNK = 48


class Permutation:
    """A keyed permutation of [0, size): an alternating Feistel network over two mixed-radix halves,
    walked along its cycle until it is back in range."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.left = math.isqrt(max(size, 1) - 1) + 1
        self.right = -(-size // self.left)
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()
        #: bytes of a round's value: 64 bits more than a half has, so that all remainders are alike
        self.width = min(64, self.left.bit_length() // 8 + 9)

    def _f(self, k: int, x: int, mod: int) -> int:
        h = hashlib.blake2b(b"%d:%d:" % (k, x) + self.tweak, key=self.key, digest_size=self.width)
        return int.from_bytes(h.digest(), "little") % mod

    def _once(self, x: int, undo: bool) -> int:
        a, b = divmod(x, self.right)
        for k in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            if k % 2:
                b = (b + (-1 if undo else 1) * self._f(k, a, self.right)) % self.right
            else:
                a = (a + (-1 if undo else 1) * self._f(k, b, self.left)) % self.left
        return a * self.right + b

    def __call__(self, x: int, ok: Callable[[int], bool] | None = None, undo: bool = False) -> int:
        """The image of ``x``; with ``ok``, within the values for which it holds (as it does for x)."""
        while True:
            x = self._once(x, undo)
            if x < self.size and (ok is None or ok(x)):
                return x


def luhn(digits: str) -> int:
    """The sum that is a multiple of 10 for a valid number."""
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total


def _iban_left(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonyms:
    """Replaces values; ``undo`` restores them."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo
        self.find = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS)).finditer
        self.anchors, self.gap = re.compile(r"[0-9@]+").finditer, re.compile(r"[ \n]").search
        self.permutation = lru_cache(maxsize=4096)(lambda tweak, size: Permutation(key, tweak, size))
        self.short = lru_cache(maxsize=50_000)(self._value)

    def value(self, kind: str, text: str) -> str | None:
        return self.short(kind, text) if len(text) <= 80 else self._value(kind, text)

    def _digits(self, tweak: str, digits: str, ok: Callable[[str], bool] | None = None) -> str:
        n = len(digits)
        test = (lambda x: ok(f"{x:0{n}d}")) if ok else None
        return f"{self.permutation(f'{tweak}{n}', 10**n)(int(digits), test, self.undo):0{n}d}"

    def _letters(self, tweak: str, letters: str) -> str:
        x = 0
        for c in letters:
            x = x * 26 + ord(c) - 97
        x = self.permutation(f"{tweak}{len(letters)}", 26 ** len(letters))(x, None, self.undo)
        out = []
        for _ in letters:
            x, c = divmod(x, 26)
            out.append(chr(97 + c))
        return "".join(reversed(out))

    def _chunks(self, permute: Callable[[str, str], str], tweak: str, run: str) -> str:
        """``run`` permuted in chunks of CHUNK: each with a tweak that holds the length and what came
        before it in the clear, so equal chunks of different values don't look alike.  The time grows
        with the length."""
        if len(run) <= CHUNK:
            return permute(tweak, run) if run else ""
        out, before = [], hashlib.blake2b(b"%d" % len(run), digest_size=16)
        for i in range(0, len(run), CHUNK):
            part = run[i : i + CHUNK]
            out.append(permute(f"{tweak}{before.hexdigest()}:", part))
            before.update((out[-1] if self.undo else part).encode())
        return "".join(out)

    @staticmethod
    def _fill(text: str, characters: str) -> str:
        """``text`` with its digits (or letters and digits) replaced in order, separators kept."""
        new = iter(characters)
        return "".join(next(new) if c.isalnum() else c for c in text)

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None if the value is not valid."""
        digits = re.sub(r"[^0-9]", "", text)
        if kind == "card":
            # without a valid check digit it is still a long number, and keeps that format
            if luhn(digits) % 10 or not 13 <= len(digits) <= 19:
                return self._fill(text, self._digits("number", digits, lambda d: luhn(d) % 10 != 0))
            body = self._digits("card", digits[:-1])
            return self._fill(text, body + str(-luhn(body + "0") % 10))
        if kind == "date":
            return self._date(text)
        if kind == "ip":
            return self._address(text)
        if kind == "ssn":
            valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
            return self._fill(text, self._digits("ssn", digits, valid)) if valid(digits) else None
        if kind in ("phone", "phone_int"):
            code = len(digits) - 10 if kind == "phone" else len(re.match(r"\+[0-9]{1,3}", text)[0]) - 1
            valid = lambda d: kind == "phone_int" or d[0] in "23456789" and d[3] in "23456789"
            real = valid(digits[code:])
            return self._fill(text, digits[:code] + self._digits(f"phone{real}", digits[code:], lambda d: valid(d) == real))
        if kind == "iban":
            compact = text.replace(" ", "")
            # 00, 01 and 99 have the remainder of 97, 98 and 02: only these are ever given
            if _iban_left(compact) != 1 or not 2 <= int(compact[2:4]) <= 98:
                return None
            body = compact[4:]
            new = self._fill_body(body)
            check = 98 - _iban_left(compact[:2] + "00" + new)
            it = iter(f"{compact[:2]}{check:02d}{new}")
            return "".join(c if c == " " else next(it) for c in text)
        local, _, domain = text.partition("@")
        return f"{self._fill_body(local)}@{domain}"

    def _address(self, text: str) -> str | None:
        """Within the addresses whose parts have as many digits each, so that what stands next to one
        meets as many digits before and after."""
        parts = text.split(".")
        octets = [int(x) for x in parts]
        if any(x > 255 or str(x) != p for x, p in zip(octets, parts)):
            return None
        first, size = (0, 10, 100), (10, 90, 156)
        x, total = 0, 1
        for octet, p in zip(octets, parts):
            x, total = x * size[len(p) - 1] + octet - first[len(p) - 1], total * size[len(p) - 1]
        x = self.permutation(f"ip{[len(p) for p in parts]}", total)(x, None, self.undo)
        out = []
        for p in reversed(parts):
            x, rest = divmod(x, size[len(p) - 1])
            out.append(str(rest + first[len(p) - 1]))
        return ".".join(reversed(out))

    def _date(self, text: str) -> str | None:
        """Within the dates that are written in the same format: order, separator and padding."""
        parts = re.split(r"[./-]", text)
        if len(parts[0]) == 4:
            order, mark = "ymd", "-"
        else:
            order, mark = ("mdy" if "/" in text and int(parts[1]) > 12 else "dmy"), text[len(parts[0])]
        padded = len(parts[0]) != 1 and len(parts[1]) != 1
        field = dict(zip(order, map(int, parts)))
        try:
            day = datetime.date(field["y"], field["m"], field["d"]).toordinal()
        except ValueError:
            return None
        if not FIRST <= day <= LAST:
            return None

        def written(x: int) -> str:
            d = datetime.date.fromordinal(FIRST + x)
            values = {"y": f"{d.year:04d}", "m": f"{d.month:02d}" if padded else str(d.month), "d": f"{d.day:02d}" if padded else str(d.day)}
            return mark.join(values[c] for c in order)

        def alike(x: int) -> bool:
            other = re.split(r"[./-]", written(x))
            month_first = mark == "/" and order != "ymd" and int(other[1]) > 12
            same_order = order == "ymd" or mark == "." or month_first == (order == "mdy")
            return same_order and list(map(len, other)) == list(map(len, parts))

        tweak = f"date{order}{mark}{list(map(len, parts))}"
        return written(self.permutation(tweak, LAST - FIRST + 1)(day - FIRST, alike, self.undo))

    def _fill_body(self, body: str) -> str:
        """Digits among digits, letters among letters of the same case, each as one number (or one for
        each CHUNK of them)."""
        digits, letters = re.sub(r"[^0-9]", "", body), re.sub(r"[^A-Za-z]", "", body)
        new_digits = iter(self._chunks(self._digits, "mixed", digits))
        new_letters = iter(self._chunks(self._letters, "letters", letters.lower()))
        pick = lambda c: next(new_digits) if c.isdigit() else (next(new_letters) if c.islower() else next(new_letters).upper()) if c.isalpha() else c
        return "".join(map(pick, body))

    def _regions(self, text: str) -> Iterator[tuple[int, int]]:
        """Disjoint stretches that can hold a value: from the word of a digit or @ on, up to the end of
        the word that is REACH characters after the last digit or @ of the stretch.

        Every value has a digit or @ in its first word.  Of all kinds but IBANs each further word has
        a digit too, and an e-mail address is one word; an IBAN is no longer than REACH.  So no value
        crosses an end of a stretch, and the values are those of a search of the whole text."""
        left = reach = right = -1
        for m in self.anchors(text):
            if m.start() > reach:
                if reach >= 0:
                    found = self.gap(text, reach)
                    right = found.start() if found else len(text)
                if m.start() > right:
                    if right >= 0:
                        yield left, right
                    # not before the end of the last stretch, where a space is
                    since = max(0, right)
                    left = max(text.rfind(" ", since, m.start()), text.rfind("\n", since, m.start())) + 1
            reach = m.end() + REACH
        if reach >= 0:
            found = self.gap(text, reach)
            yield left, found.start() if found else len(text)

    def replace(self, text: str | None) -> tuple[str | None, list[tuple[int, str, int]]]:
        """The text with its pseudonyms, and the spans (start, kind, end) of the values in it."""
        if text is None:
            return None, []
        out, spans, last = [], [], 0
        for m in (m for a, b in self._regions(text) for m in self.find(text, a, b)):
            kind = next(k for k in KINDS if m[k] is not None)
            new = self.value(kind, m[0])
            if new is not None:
                spans.append((m.start(), kind, m.end()))
                out += [text[last : m.start()], new]
                last = m.end()
        return ("".join([*out, text[last:]]) if spans else text), spans


def pseudonymise(docs: DataFrame, key: bytes, undo: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, and spans (array of start, kind, end; code points of the input).

    Values: e-mail addresses (domain kept), IBANs, dates, IPv4 addresses, US social security and
    telephone numbers, international numbers, card numbers and other numbers of 13 to 19 digits.
    Values that fail their check (a 31st of June, an octet over 255, an IBAN's check digits) are not
    such values and stay.  Null stays null, an empty table gives no rows, repeated rows are alike.
    The local part of an address may have any length.  ``undo`` with the same key restores the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, undo)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in batches:
            done = [names.replace(t) for t in batch.column("text").to_pylist()]
            spans = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for _, s in done]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([t for t, _ in done], pa.string()), "spans": pa.array(spans, kind)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<start:int,kind:string,end:int>>")
