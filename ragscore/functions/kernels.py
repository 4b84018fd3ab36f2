"""Pure-Python kernels behind Arrow UDFs: Porter stems, longest common subsequence, 13a tokens, murmur3."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_VOWELS = set("aeiou")


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    shape = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", shape))


def _has_vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# The suffix rules of Porter's published algorithm (1980), steps 2 to 4.
_STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
_STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
PORTER_STEP2, PORTER_STEP3 = ([tuple(r.split(" ")) for r in s.split(",")] for s in (_STEP2, _STEP3))
PORTER_STEP4 = _STEP4.split()


def _replace(w: str, rules: list[tuple[str, str]]) -> str:
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(old):
            stem = w[: len(w) - len(old)]
            return stem + new if _measure(stem) > 0 else w
    return w


@lru_cache(maxsize=100_000)
def porter_stem(w: str) -> str:
    """Porter's stemmer for a lower-case word."""
    if len(w) < 3:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, PORTER_STEP2), PORTER_STEP3)
    for suffix in sorted(PORTER_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def rouge_stems(tokens: list[str]) -> list[str]:
    return [porter_stem(t) if len(t) > 3 else t for t in tokens]


def lcs_length(a: Sequence, b: Sequence) -> int:
    """One vectorised row for each token of the shorter side; tokens may be strings or numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    ids: dict = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in (side.tolist() if isinstance(side, np.ndarray) else side)]) for side in (a, b))
    row = np.zeros(len(y) + 1, np.int32)
    for t in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == t)))
    return int(row[-1])


_RULES_13A = [(re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 ")]


def tokens_13a(text: str) -> list[str]:
    """The published mteval-13a tokenisation."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, to in _RULES_13A:
        text = pattern.sub(to, text)
    return text.split()


def bleu_statistics(prediction: str, reference: str, order: int = 4) -> list[int]:
    return ngram_statistics(tokens_13a(prediction), tokens_13a(reference), order)


def ngram_statistics(p: list[str], r: list[str], order: int = 4) -> list[int]:
    """Lengths of both sides, then clipped matches and totals of each order."""
    out = [len(p), len(r)]
    for n in range(1, order + 1):
        a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (p, r))
        out += [sum((a & b).values()), max(0, len(p) - n + 1)]
    return out


@lru_cache(maxsize=200_000)
def murmur3(text: str, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit of the UTF-8 bytes, signed."""
    data, mask = text.encode(), 0xFFFFFFFF
    h, n = seed, len(data)

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    for i in range(0, n - n % 4, 4):
        h ^= scramble(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if n % 4:
        h ^= scramble(int.from_bytes(data[n - n % 4 :], "little"))
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def token_codes(*columns: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    """Ends and codes of the tokens of each column of arrays, and the tokens by code: no token becomes a Python object. A null array counts as empty."""
    ends = [np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(c), 0).to_numpy())] for c in columns]
    flat = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode()
    cuts = np.cumsum([0] + [int(e[-1]) for e in ends])
    codes = flat.indices.to_numpy()
    return ends, [codes[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], flat.dictionary
