"""Operator 5: exact BPE encoding and decoding.

Encoding walks a word once: an Aho-Corasick automaton over the vocabulary gives the longest token at each place; a token
is taken if it is *compatible* with the one before it, that is if merging their joined text ends in just these two.
Where it is not, the next shorter token that is a prefix of it is tried, and where none is left the last token is given
back and its place is marked, so that no place is entered twice.  Compatibility of two tokens follows from the merges
on the right edge of one and the left edge of the other, undone latest first, and is kept in a table.  Words repeat, so
each process keeps a bounded table of encoded words.

Decoding copies slices of one byte string that holds all tokens, at places given by an offset table.

Defined cases: null text encodes and decodes as empty; special tokens written out in a text become their single ids, as
the public library has it; rows pass through unchanged and in number; the operator's columns win over clashing names.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.shipping import held

TOKENIZER = "word_bpe_49k.json"
#: Entries of the tables of words and of token pairs that a process holds.
TABLE = 400_000
#: Ids that are decoded at a time.
BLOCK = 1 << 16
_NEVER = 1 << 62
_IDS = struct.Struct("<I")
#: A word's last symbol lies this far above the plain one.
_END = 0x1000

#: Ranges of the letters and numbers that Unicode 16 added; lower-case letters that 16 and 17 added.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]
LOWER_NEW = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER_NEW |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class _Words(dict):
    """Word -> packed little-endian ids; forgets all when full."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= TABLE:
            self.clear()
        found = self[word] = self.encode(word)
        return found


class Bpe:
    """Encoder and decoder of a word-end BPE vocabulary in the public JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._patterns(split["pattern"]["Regex"])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        symbols = [self._symbols(t) for t in self.vocab]
        ids = list(self.vocab.values())
        self.size = max([*ids, *special.values()]) + 1
        by_text = dict(zip(symbols, ids, strict=True))
        self.length = [0] * self.size
        for s, i in zip(symbols, ids, strict=True):
            self.length[i] = len(s)
        self.born = [-1] * self.size
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.merged: dict[tuple[int, int], int] = {}
        usable = [n == 1 for n in self.length]
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, t = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merged[x, y] = rank
            if self.born[t] < 0 and self.length[t] > 1:
                self.born[t], self.left[t], self.right[t] = rank, x, y
                usable[t] = usable[x] and usable[y] and self._apart(x, y, rank)
        self.pairs: dict[int, bool] = {}
        self.shorter = [-1] * self.size
        self.automaton = ahocorasick.Automaton()
        for s, i in by_text.items():
            if usable[i]:
                self.automaton.add_word(s[::-1], i)
                self.shorter[i] = next((by_text[s[:n]] for n in range(len(s) - 1, 0, -1) if usable[by_text.get(s[:n], i)] and s[:n] in by_text), -1)
        self.automaton.make_automaton()
        self.whole = {s: i for s, i in by_text.items() if usable[i]}
        self.symbol = dict(enumerate(byte_symbols()))
        self.words = _Words(self._encode_word)
        self._offsets(special)

    def _patterns(self, pattern: str) -> None:
        """The pattern for Latin-1 texts, with its classes spelled out, and for all others.

        Letters and numbers that Unicode has gained since the library's tables, of version 16, are neither there; Python's
        tables are older, so those that came with that version are listed.
        """
        known = {chr(c) for first, last in UNICODE_16 for c in range(first, last + 1)}
        new = "".join(regex.escape(c) for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))) if unicodedata.category(c) == "Cn" and c not in known)
        fixed = pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}][{new}]]").replace(r"[\p{L}]", f"[\\p{{L}}--[{new}]]").replace(r"[\p{N}]", f"[\\p{{N}}--[{new}]]") if new else pattern
        self.find = regex.compile(fixed, regex.V1).findall
        sets = {k: "".join(re.escape(chr(c)) for c in range(256) if regex.match(k, chr(c))) for k in (r"[\p{L}]", r"[\p{N}]", r"[^\s\p{L}\p{N}]")}
        for k, v in sets.items():
            pattern = pattern.replace(k, f"[{v}]")
        self.find_latin = re.compile(pattern).findall

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + _END)
        return token

    def _apart(self, x: int, y: int, limit: int = _NEVER) -> bool:
        """Whether no merge joins x's end to y's start before limit; equal ranks go to the leftmost pair."""
        born, left, right, merged = self.born, self.left, self.right, self.merged
        end_x = end_y = limit
        while True:
            rank = merged.get((x, y), _NEVER)
            if rank < end_x and rank <= end_y and rank != limit:
                return False
            if born[x] > born[y]:
                end_x, x = born[x], right[x]
            elif born[y] >= 0:
                end_y, y = born[y], left[y]
            else:
                return True

    def _compatible(self, x: int, y: int) -> bool:
        key = x * self.size + y
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= TABLE:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(x, y)
        return known

    def _encode_word(self, word: str) -> bytes:
        raw = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.symbol)
        n = len(raw)
        text = raw[:-1] + chr(ord(raw[-1]) + _END) if self.suffix else raw
        whole = self.whole.get(text)
        if whole is not None:
            return _IDS.pack(whole)
        longest = [-1] * n
        last = n - 1
        for end, token in self.automaton.iter(text[::-1]):
            if longest[last - end] < 0:  # the longest of a place comes first
                longest[last - end] = token
        length, shorter, pairs, size = self.length, self.shorter, self.pairs, self.size
        open_ = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        before = -1
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if open_[end]:
                    if before < 0:
                        break
                    fits = pairs.get(before * size + token)
                    if self._compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                before = token
                at = end
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                token = out.pop()
                before = out[-1] if out else -1
                at -= length[token]
                token = shorter[token]
        return array("I", out).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if self.split_special and "<|" in text:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.split_special(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter, so no final sigma
            return b"".join(map(self.words.__getitem__, self.find(text.lower().translate(LOWER_NEW))))
        return b"".join(map(self.words.__getitem__, self.find_latin(text.lower())))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text or ""), "<u4")

    def _offsets(self, special: dict[str, int]) -> None:
        names = [""] * self.size
        for t, i in (*self.vocab.items(), *special.items()):
            names[i] = t
        pieces = [(t + " ").encode() for t in names]  # without a decoder the library parts tokens by blanks
        self.stop = np.cumsum([len(p) for p in pieces])
        self.start = np.r_[0, self.stop[:-1]]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self._slices(ids[s : s + BLOCK]) for s in range(0, len(ids), BLOCK))[:-1]

    def _slices(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        start, size = self.start[ids], self.stop[ids] - self.start[ids]
        reach = np.cumsum(size)
        return self.blob[np.arange(reach[-1]) - np.repeat(reach - size - start, size)].tobytes()


def load(path: str) -> Bpe:
    """One Bpe for each process, until that needs another model."""
    return held(("bpe", path), lambda: Bpe(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encode(path: str) -> Callable[[Column], Column]:
    """Column function: text -> array of ids."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for batch in batches:
            packed = [bpe.packed(t or "") for t in batch.to_pylist()]
            offsets = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))

    return F.arrow_udf(run, "array<int>")


def decode(path: str) -> Callable[[Column], Column]:
    """Column function: array of ids -> text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for batch in batches:
            flat, offsets = batch.values.to_numpy(), batch.offsets.to_numpy()
            yield pa.array([bpe.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary()).cast(pa.string())

    return F.arrow_udf(run, "string")


def round_trip(path: str) -> Callable[[Column], Column]:
    """Column function: text -> struct of its ids and of what they decode to, in one process.

    Two functions in a row would run in two processes for each core, each with a vocabulary, and send all ids there and
    back.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for batch in batches:
            packed, decoded = [], []
            for text in batch:
                ids = bpe.packed(text.as_py() or "")
                packed.append(ids)
                decoded.append(bpe.decode(np.frombuffer(ids, "<u4")))
            offsets = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            del packed
            texts = pa.array(decoded, pa.binary()).cast(pa.string())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), flat), texts], ["ids", "decoded"])

    return F.arrow_udf(run, "ids array<int>, decoded string")


def bpe_round_trip(documents: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """The input with ids (array<int>) and decoded (string)."""
    told = documents.withColumn("_round_trip", round_trip(path or default_path())(F.col(text_col).cast("string")))
    return told.withColumns({"ids": F.col("_round_trip.ids"), "decoded": F.col("_round_trip.decoded")}).drop("_round_trip")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
