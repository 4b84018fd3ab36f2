"""Vectorised window scan that the two repeated-passage operators share.

Every window of ``width`` consecutive units (bytes or words) of a text is assigned to an *anchor*: the position of the
smallest hash among the ``gram``-unit substrings inside the window, leftmost on ties.  The choice depends on nothing but
the window's content, so equal windows always have equal anchors at equal offsets (unequal ones may share an anchor,
which costs a comparison, no more).  Consecutive windows that share one anchor form a *run*; the bytes a run covers are
hashed once, by XXH64.  Two rows per about ``width - gram`` units are then enough to
find every repeated window of a corpus, where a plain table of windows needs one row per unit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

#: Units a block of texts holds at most; a position inside a block fits the low bits of an anchor key.
BLOCK_BITS = 20
BLOCK = 640 << 10
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_LOW = _U((1 << BLOCK_BITS) - 1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


#: One pseudo-random odd 64-bit value per byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for at least n positions."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = []
        for base in (_MULT, _INV):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Prefix sums from which the hash of any substring follows in constant time."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _power_tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def hashes(self, start, stop) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


@dataclass
class Units:
    """The units of a block of texts.

    values choose anchors; raw holds the units' bytes and decides.  item: the text each unit is of; base: a text's first
    unit; skip: units of its text before the block; starts, stops: bytes of each word.
    """

    values: np.ndarray
    item: np.ndarray
    base: np.ndarray
    skip: np.ndarray
    raw: bytes = b""
    starts: np.ndarray | None = None
    stops: np.ndarray | None = None

    def digests(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """XXH64 of the bytes of the units [start, stop), one blank between words."""
        if self.starts is not None:
            start, stop = self.starts[start], self.stops[stop - 1]
        raw, digest = memoryview(self.raw), xxhash.xxh64_intdigest
        return np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), _U, len(start))


@dataclass
class Runs:
    """Runs of windows, by block position: [start, start + count) are the first units of the windows; anchor: units from start to the anchor."""

    item: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    anchor_hash: np.ndarray
    content_hash: np.ndarray


def scan(units: Units, prefix: Prefix, width: int, gram: int) -> Runs:
    """All runs of windows of a block; windows never cross texts."""
    n = len(units.values)
    if n < width:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, none.astype(_U), none.astype(_U))
    grams = mix(prefix.all_of(gram))
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=_U)
    anchor = (sliding_min(keys, width - gram + 1) & _LOW).astype(np.int64)
    at = np.flatnonzero(units.item[: n - width + 1] == units.item[width - 1 :])
    if not len(at):
        return scan(Units(units.values[:0], units.item[:0], units.base, units.skip), prefix, width, gram)
    anchor = anchor[at]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])])
    count = np.diff(np.r_[first, len(at)])
    start = at[first]
    content = units.digests(start, start + count + width - 1)
    return Runs(units.item[start], start, count, anchor[first] - start, mix(grams[anchor[first]]), content)


def byte_units(texts: list[bytes], skip: list[int]) -> Units:
    joined = b"".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    return Units(BYTE_VALUE[raw], np.repeat(np.arange(len(texts), dtype=np.int32), size), np.cumsum(size) - size, np.array(skip, np.int64), joined)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one byte of every word [^\\x20\\x09-\\x0D]+."""
    edge = np.diff(np.r_[True, IS_SPACE[raw], True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_units(texts: list[bytes], skip: list[int]) -> Units:
    texts = [b" ".join(t.split()) for t in texts]
    joined = b" ".join(texts)
    raw = np.frombuffer(joined, np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    starts, stops = word_spans(raw)
    values = mix(Prefix(BYTE_VALUE[raw]).hashes(starts, stops)) if len(starts) else np.zeros(0, _U)
    item = (np.searchsorted(np.cumsum(size), starts, "right")).astype(np.int32)
    return Units(values, item, np.searchsorted(item, np.arange(len(texts))), np.array(skip, np.int64), joined, starts, stops)


def blocks(texts: list[bytes], width: int, unit: str):
    """(indices of texts, Units) of bounded size; a longer text is cut into blocks that overlap by width - 1 units."""
    make = byte_units if unit == "byte" else word_units
    held: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if size + len(text) + len(held) >= BLOCK and held:
            yield held, make([texts[j] for j in held], [0] * len(held))
            held, size = [], 0
        if len(text) + 1 >= BLOCK:
            for piece, skip in _pieces(text, width, unit):
                yield [i], make([piece], [skip])
        else:
            held.append(i)
            size += len(text)
    if held:
        yield held, make([texts[j] for j in held], [0] * len(held))


def _pieces(text: bytes, width: int, unit: str):
    if unit == "byte":
        step = BLOCK // 2
        for s in range(0, max(1, len(text) - width + 1), step):
            yield text[s : s + step + width - 1], s
        return
    words = text.split()
    held, size, first = [], 0, 0
    for i, w in enumerate(words):
        if held and size + len(w) + 1 >= BLOCK // 2 and len(held) >= 2 * width:
            yield b" ".join(held), first
            held = held[len(held) - (width - 1) :]
            first = i - len(held)
            size = sum(map(len, held)) + len(held)
        held.append(w)
        size += len(w) + 1
    if held:
        yield b" ".join(held), first
