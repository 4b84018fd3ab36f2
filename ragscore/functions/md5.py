"""MD5 of many short texts at once, by array operations over the four words of the state."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in four]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, (7 * i) % 16)[i // 16] for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes that one block of MD5 holds beside its padding, and texts whose state is held at once (a core's cache).
ROOM, STEP = 55, 24576


def _first_words(message: list[np.ndarray | int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of n messages of one block, given by their 16 words: arrays, or one number for all."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = message[_PLACES[i]]
        if isinstance(word, int):
            np.add(f, np.uint32((_SINES[i] + word) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, word, out=f)
            np.add(f, np.uint32(_SINES[i]), out=f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=t)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def _columns(texts: list[bytes], width: int) -> np.ndarray:
    """Texts padded to width bytes, as rows of little-endian words for each place; those that are longer are left out."""
    whole = b"".join((x if len(x) <= width else b"").ljust(width, b"\0") for x in texts)
    return np.ascontiguousarray(np.frombuffer(whole, "<u4").astype(np.uint32).reshape(len(texts), width // 4).T)


def joined_md5(heads: list[bytes], tails: list[bytes]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (head numbers, tail numbers): the first eight bytes of MD5 of each head followed by its tail, as numbers in the order of the digests."""
    lengths, ends = np.array([len(x) for x in heads], np.int64), np.array([len(x) for x in tails], np.int64)
    width = 4 * (-(-(int(np.minimum(ends, ROOM).max(initial=0)) + 4) // 4))
    first = _columns(heads, 56)
    last = [_columns([b"\0" * at + x + b"\x80" if len(x) <= ROOM else b"" for x in tails], width) for at in range(4)]
    # 16 bits are sorted by radix
    lengths_of, kind_of = np.unique(lengths, return_inverse=True)
    kind_of = kind_of.astype(np.uint16 if len(lengths_of) < 1 << 16 else np.int64)

    def block(i: np.ndarray, j: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
        word, shift = divmod(n, 4)
        message: list[np.ndarray | int] = [0] * 16
        for w in range(-(-n // 4)):
            message[w] = first[w].take(i, mode="clip")  # clip spares a check of each number
        for w in range(-(-(shift + int(m.max()) + 1) // 4)):
            part = last[shift][w].take(j, mode="clip")
            message[word + w] = part if isinstance(message[word + w], int) else message[word + w] | part
        message[14] = (8 * (n + m)).astype(np.uint32)
        a, b = _first_words(message, len(i))
        return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()

    def run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.uint64)
        kind = kind_of.take(i, mode="clip")
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(len(lengths_of) + 1))
        for n, lo, hi in zip(lengths_of.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for s in range(lo, hi, STEP):
                at = order[s : min(hi, s + STEP)]
                m = ends.take(j[at], mode="clip")
                if n + int(m.max()) > ROOM:  # more than a block
                    long = n + m > ROOM
                    out[at[long]] = [int.from_bytes(hashlib.md5(heads[p] + tails[q]).digest()[:8]) for p, q in zip(i[at[long]].tolist(), j[at[long]].tolist(), strict=True)]
                    at, m = at[~long], m[~long]
                if len(at):
                    out[at] = block(i[at], j[at], n, m)
        return out

    return run
