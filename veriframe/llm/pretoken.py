"""Pre-tokens of texts, found for many documents at once by character class.

Two splits are offered.  "spaced" is the public pattern of byte-level BPE files
(contractions, then runs of letters, digits or other signs with at most one
leading space, then white space); "bare" is the pattern of the lower-cased word
BPE file (contractions, runs of letters, single digits, runs of other signs, no
white space).  Both follow from the class of each code point and its neighbours.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from . import kernel

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
#: Fixed: the code points of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ALL = 0x110000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class and the hash of each code point."""
    kinds = np.zeros(_ALL, np.uint8)
    for i in range(_ALL):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            kinds[i] = LETTER
        elif c == "N":
            kinds[i] = DIGIT
    kinds[WHITE_SPACE] = SPACE
    return kinds, kernel.mix(np.arange(1, _ALL + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split(cp: np.ndarray, bounds: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens of the texts ``cp[bounds[i]:bounds[i + 1]]``."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _tables()[0][cp]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[bounds] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[0] = run[n] = True
    start = run[:n].copy()
    at = np.flatnonzero(run[:n])
    after = np.append(at[1:], n)
    if style == "spaced":
        before_more = (kind[at] == SPACE) & ~edge[after]
        start[after[before_more] - 1] = True
        glued = at[(at > 0) & ~edge[at] & (kind[at] != SPACE)]
        glued = glued[cp[glued - 1] == 0x20]
        start[glued] = False
    else:
        start |= kind == DIGIT
        start &= kind != SPACE
    quote = at[(after - at == 1) & (cp[at] == 0x27) & start[at] & ~edge[after]]
    quote = quote[kind[np.minimum(quote + 1, n - 1)] == LETTER]
    if len(quote):
        padded = np.append(cp, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        two = np.where(run[np.minimum(quote + 2, n)], 0, two)
        long = np.zeros(len(quote), np.int64)
        long[np.isin(one, [ord(c) for c in "stmd"])] = 1
        for a, b in ("re", "ve", "ll"):
            long[(one == ord(a)) & (two == ord(b))] = 2
        quote, long = quote[long > 0], long[long > 0]
        start[quote + 1] = False
        rest = quote + 1 + long
        inside = (rest < n) & ~run[np.minimum(rest, n)]
        start[rest[inside]] = True
    starts = np.flatnonzero(start)
    cut = start if style == "spaced" else start | run[:n]
    stops = np.append(np.flatnonzero(cut), n)
    return starts, stops[np.searchsorted(stops, starts, side="right")]


def hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return kernel.symbol_span_hash(_tables()[1][cp], starts, ends)


def texts(column: pa.Array) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """(first row, joined text, code points, bounds) of runs of rows."""
    for first, raw, bounds in kernel.chunks(column):
        joined = raw.tobytes().decode("utf-8", errors="replace")
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        yield first, joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), lead[bounds]


def lowered_texts(column: pa.Array, specials: tuple[str, ...] = ()) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``texts``, after NFC and lower case, with the number of special strings of each text, which are taken out."""
    marks = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
    for first, raw, bounds in kernel.chunks(column):
        parts = [raw[a:b].tobytes().decode("utf-8", errors="replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        count = np.zeros(len(parts), np.int64)
        for i, part in enumerate(parts):
            if any(s in part for s in specials):
                part, count[i] = marks.subn(" ", part)
            if not part.isascii():  # lower case goes by single letters, so no sigma is a final one
                part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")
            parts[i] = part.lower()
        joined = "".join(parts)
        yield first, joined, np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), count


class WordTable:
    """Values of words by hash, in sorted hash arrays; it grows as words are met."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        order = np.argsort(keys)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        self.keys, self.sizes, self.starts, self.flat = keys[order], sizes[order], starts[:-1][order], flat

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each hash."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return at, self.keys[at] == wanted

    def add(self, keys: np.ndarray, values: list[list[int]]) -> None:
        """Takes new words; ``keys`` ascend."""
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        new = np.fromiter((x for v in values for x in v), self.flat.dtype, int(sizes.sum()))
        at = np.searchsorted(self.keys, keys)
        self.starts = np.insert(self.starts, at, len(self.flat) + np.cumsum(sizes) - sizes)
        self.keys, self.sizes, self.flat = np.insert(self.keys, at, keys), np.insert(self.sizes, at, sizes), np.concatenate([self.flat, new])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, bounds): the values of the words at ``at``, one after the other."""
        return ragged(self.flat, self.starts[at], self.sizes[at])


class GrowingWords:
    """As ``WordTable``, for tables that go on growing: words keep the places in which they came, and a slot table of at most half load leads to them."""

    def __init__(self, least_slots: int = 1 << 16) -> None:
        self.n, self.n_flat = 0, 0
        self.keys, self.sizes, self.starts = np.zeros(1, np.uint64), np.zeros(1, np.int32), np.zeros(1, np.int64)
        self.flat = np.zeros(1, np.int32)
        self._slots = np.full(least_slots, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(65 - len(self._slots).bit_length())).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each hash."""
        slot = self._home(wanted)
        at = self._slots[slot]
        open_ = np.flatnonzero((at >= 0) & (self.keys[at] != wanted))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self._slots) - 1)
            at[open_] = self._slots[slot[open_]]
            open_ = open_[(at[open_] >= 0) & (self.keys[at[open_]] != wanted[open_])]
        return at, at >= 0

    def add(self, keys: np.ndarray, values: list[list[int]]) -> None:
        """Takes new words, each once."""
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        first, begin = self.n, self.n_flat
        self.n, self.n_flat = first + len(keys), begin + int(sizes.sum())
        self.keys, self.sizes, self.starts = (_room(x, self.n) for x in (self.keys, self.sizes, self.starts))
        self.flat = _room(self.flat, self.n_flat)
        self.keys[first : self.n], self.sizes[first : self.n] = keys, sizes
        self.starts[first : self.n] = begin + np.cumsum(sizes) - sizes
        self.flat[begin : self.n_flat] = np.fromiter(chain.from_iterable(values), np.int32, self.n_flat - begin)
        if 2 * self.n > len(self._slots):
            self._slots = np.full(1 << (2 * self.n).bit_length(), -1, np.int32)
            first = 0
        at = np.arange(first, self.n, dtype=np.int32)
        slot = self._home(self.keys[first : self.n])
        while len(at):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = at[free]
            rest = self._slots[slot] != at  # their slot is another word's
            at, slot = at[rest], (slot[rest] + 1) & (len(self._slots) - 1)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, bounds): the values of the words at ``at``, one after the other."""
        return ragged(self.flat, self.starts[at], self.sizes[at])


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """``held`` with place for ``n`` items, half as long again each time it grows."""
    if n <= len(held):
        return held
    out = np.zeros(max(n, 3 * len(held) // 2), held.dtype)
    out[: len(held)] = held
    return out


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def encode_column(column: pa.Array, words: WordTable | GrowingWords, encode: Callable[[list[str]], list[list[int]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids, bounds) of runs of rows; ``encode`` is asked once for each word that ``words`` doesn't hold."""
    for first, joined, cp, bounds in texts(column):
        starts, ends = split(cp, bounds, "spaced")
        keys = hashes(cp, starts, ends)
        at, found = words.find(keys)
        if not found.all():
            fresh, where = np.unique(keys[~found], return_index=True)
            s, e = starts[~found][where].tolist(), ends[~found][where].tolist()
            words.add(fresh, encode([joined[a:b] for a, b in zip(s, e, strict=True)]))
            at, _ = words.find(keys)
        ids, upto = words.gather(at)
        yield first, ids, upto[np.searchsorted(starts, bounds)]
