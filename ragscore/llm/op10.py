"""Operator 10: language identification by a byte convolutional network.

Text is lower-cased, its ASCII non-letters become blanks, and its UTF-8 bytes are cut into windows of WINDOW bytes that
cover it whole (the last one is padded).  Filters of several widths slide over a window; each keeps its largest response
(max pooling), and a softmax layer turns these into class probabilities.  A document's prediction is the class with the
highest mean log-probability over its windows, weighted by their bytes; its score is the mean probability of that class.

The network is trained in numpy, by Adam on cross-entropy, on all windows of at most ``fit_rows`` labelled texts (lowest
hash of the id first).

Defined cases: null text and text without a letter give ``und`` with score 0; without any labelled row everything is
``und``; rows pass through in number, repeated rows get equal answers; columns other than id, text and, for training,
language are not read; a column that has the name of the answer (``into``) gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.common import lowest

WINDOW = 512
WIDTHS = (2, 3, 4)
FILTERS = 16
FIT_ROWS = 2_000
UNKNOWN = "und"
HELD_OUT = 2
_LETTER = re.compile(r"[^\W\d_]").search  # letters, and numbers such as one half
_CLEAN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 4, is 2: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT, F.lit(False))


def has_letter(text: str) -> bool:
    found = _LETTER(text)
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def to_bytes(text: str) -> bytes:
    return text.lower().encode().translate(_CLEAN)


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    n = max(1, -(-len(raw) // size))
    return np.frombuffer(raw.ljust(n * size, b" "), np.uint8).reshape(n, size)


class ByteCnn:
    def __init__(self, classes: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)
        self.tables = None

    def _responses(self, x: np.ndarray, k: int) -> np.ndarray:
        """(windows, places, filters) for the k-th width."""
        w = WIDTHS[k]
        if self.tables is None:
            places = x.shape[1] - w + 1
            return sum(self.filters[k][j][x[:, j : j + places]] for j in range(w))
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        places = x.shape[1] - w + 1
        found = self.tables[k][0][pair[:, :places]]
        if w == 3:
            found += self.filters[k][2][x[:, 2:]]
        elif w == 4:
            found += self.tables[k][1][pair[:, 2 : 2 + places]]
        return found

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([self._responses(x, k).max(1) for k in range(len(WIDTHS))], 1) + self.bias, 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int | None = None, batch: int = 64, rate: float = 0.01, seed: int = 3) -> ByteCnn:
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.bias, self.out, self.out_bias]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs or max(3, -(-400 * batch // max(1, len(x))))):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                rows = order[s : s + batch]
                b, target = x[rows], y[rows]
                n = len(rows)
                best, values = [], []
                for k in range(len(WIDTHS)):
                    r = self._responses(b, k)
                    at = r.argmax(1)
                    best.append(at)
                    values.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
                pre = np.concatenate(values, 1) + self.bias
                hidden = np.maximum(pre, 0)
                z = hidden @ self.out + self.out_bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(n), target] -= 1
                p /= n
                d_hidden = (p @ self.out.T) * (pre > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.filters[k])
                    d = d_hidden[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (b[np.arange(n)[:, None], best[k] + j], np.arange(FILTERS)[None, :]), d)
                    grads.append(g)
                grads += [d_hidden.sum(0), hidden.T @ p, p.sum(0)]
                t += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    q -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def ready(self) -> ByteCnn:
        """Sums the responses of byte pairs once; a width then takes one or two look-ups a place."""
        pairs = []
        for f in self.filters:
            pairs.append([(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, len(f) - 1, 2)])
        self.tables = pairs
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.classes or not has_letter(text):
            return UNKNOWN, 0.0
        raw = to_bytes(text)
        x = windows(raw)
        logs = np.concatenate([self.log_probabilities(x[s : s + 64]) for s in range(0, len(x), 64)])
        return self._vote(logs, len(raw))

    def _vote(self, logs: np.ndarray, size: int) -> tuple[str, float]:
        weight = np.full(len(logs), float(WINDOW))
        weight[-1] = max(1, size - WINDOW * (len(logs) - 1))
        weight /= weight.sum()
        best = int((weight @ logs).argmax())
        return self.classes[best], float(min(1.0, weight @ np.exp(logs[:, best].astype(np.float64))))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """As predict, with the windows of many texts in one pass."""
        out: list = [(UNKNOWN, 0.0)] * len(texts)
        held: list[tuple[int, np.ndarray, int]] = []
        many = 0

        def flush():
            nonlocal held, many
            if held:
                logs = self.log_probabilities(np.concatenate([x for _, x, _ in held]))
                at = 0
                for i, x, size in held:
                    out[i] = self._vote(logs[at : at + len(x)], size)
                    at += len(x)
            held, many = [], 0

        for i, text in enumerate(texts):
            if text is None or not self.classes or not has_letter(text):
                continue
            if len(text) > 64 * WINDOW:
                out[i] = self.predict(text)
                continue
            raw = to_bytes(text)
            x = windows(raw)
            held.append((i, x, len(raw)))
            many += len(x)
            if many >= 64:
                flush()
        flush()
        return out


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> ByteCnn:
    """The network, from a bounded sample of rows that are not held out and have a language and a letter."""
    text = F.col(text_col).cast("string")
    rows = documents.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("at"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"))
    table = lowest(rows, "at", fit_rows, rows.text.rlike(r"\p{L}"), "text").select("lang", "text").toArrow()
    langs = table["lang"].to_pylist()
    classes = sorted(set(langs))
    model = ByteCnn(classes)
    if classes:
        x = [windows(to_bytes(t)) for t in table["text"].to_pylist()]
        y = np.repeat([classes.index(v) for v in langs], [len(w) for w in x])
        model.fit(np.concatenate(x), y)
    return model


def _predictor(model: ByteCnn) -> Callable[[Column], Column]:
    from ragscore.llm.shipping import give_back, shipped

    get = shipped(model, ByteCnn.ready)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = get()
        for batch in batches:
            found = net.predict_all(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang_pred", "score"])
        give_back()

    return F.arrow_udf(run, "lang_pred string, score double")


def language_id(documents: DataFrame, model: ByteCnn, text_col: str = "text", into: str = "language") -> DataFrame:
    """The input with a struct column ``into`` (lang_pred, score)."""
    return documents.withColumn(into, _predictor(model)(F.col(text_col).cast("string")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id(documents.select("doc_id", "text"), train(documents))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score")
