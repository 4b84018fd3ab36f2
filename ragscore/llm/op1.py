"""Operator 1: toxicity by maximum-scoring segments.

Tokens are lower-cased words; a token stands for itself and for its leading PREFIXES letters.  Log-odds of toxic against
clean documents, with an informative Dirichlet prior (the token's own corpus share, worth PRIOR of all tokens), give each
significant one a score; all others share one small negative score, so a run of text scores above zero only around
evidence.  The linear scan of Ruzzo and Tompa finds every maximal scoring segment.  Scores being log-likelihood ratios,
chance segments in n tokens exceed S about n exp(-S) times (extreme-value law with its scale at 1); a segment's surprise
is S - ln n, segments of positive surprise add up, and a logistic curve fitted on the training rows turns the sum into
the score.

Fitting reads at most ``fit_rows`` labelled rows (lowest hash of the id first) that are not held out; equal texts count
once.  At most MAX_TOKENS tokens, those of the largest z, are kept.

Defined cases: null and blank texts have no segment and get the score of a text without evidence; texts are read whole;
without labels of both kinds every score is the share of toxic rows, 0 if none; repeated rows get equal answers; ids with
several labels count with each; columns other than id and text are not read, one that has the name of the answer
(``into``) gives way to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.common import lowest, written
from ragscore.llm.op10 import held_out
from ragscore.llm.shipping import give_back, shipped

FIT_ROWS = 12_000
PREFIXES = (4, 5, 6, 7)
PRIOR = 0.05
MIN_Z = 3.0
MIN_DOCUMENTS = 4
MAX_TOKENS = 20_000
CUT = 0.3
_WORDS = re.compile(r"\w+").findall
_TABLE = 60_000
_SEGMENTS = "array<struct<start: int, stop: int, score: double>>"


def features(token: str) -> list[str]:
    return [token, *[token[:n] + "*" for n in PREFIXES if len(token) >= n]]


@dataclass
class Model:
    """Scores of significant tokens, the score of all others, and the calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    neutral: float = -0.01
    intercept: float = 0.0
    slope: float = 0.0

    def prepared(self) -> Model:
        weights = self.weights

        class Scores(dict):
            def __missing__(self, token: str) -> float:
                if len(self) >= _TABLE:
                    self.clear()
                best = max((weights[f] for f in features(token) if f in weights), default=0.0)
                self[token] = best
                return best

        self.scores = Scores()
        return self

    def segments(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (start, stop, score), in order."""
        if not self.weights or not tokens:
            return []
        scores = np.fromiter(map(self.scores.__getitem__, tokens), np.float64, len(tokens))
        # kept segments as (start, stop, sum before start, sum up to stop), per Ruzzo and Tompa
        kept: list[tuple[int, int, float, float]] = []
        total, seen = 0.0, 0
        for at in np.flatnonzero(scores > 0).tolist():
            total += self.neutral * (at - seen)
            start, before = at, total
            total += float(scores[at])
            seen = at + 1
            stop, after = at + 1, total
            while True:
                j = len(kept) - 1
                while j >= 0 and kept[j][2] >= before:
                    j -= 1
                if j < 0 or kept[j][3] >= after:
                    kept.append((start, stop, before, after))
                    break
                start, before = kept[j][0], kept[j][2]
                del kept[j:]
        return [(s, e, b - a) for s, e, a, b in kept]

    def surprise(self, found: list[tuple[int, int, float]], n: int) -> float:
        floor = math.log(n + 1)
        best = max((s for _, _, s in found), default=0.0) - floor
        return best if best <= 0 else sum(s - floor for _, _, s in found if s > floor)

    def read(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        tokens = _WORDS((text or "").lower())
        found = self.segments(tokens)
        return self.surprise(found, len(tokens)) if found else -20.0, found

    def score(self, surprise: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.intercept + self.slope * surprise))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each feature of a document and one for the document's size."""
    names: list[str] = []
    toxic: list[int] = []

    def packed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], ["feature", "toxic"])
        names.clear()
        toxic.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = {f for t in set(_WORDS((text or "").lower())) for f in features(t)}
            names.extend(found)
            toxic.extend([label] * len(found))
            if len(names) > 50_000:
                yield packed()
    yield packed()


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    ids = lowest(ids.withColumn("_at", F.xxhash64(F.col(id_col).cast("string"))), "_at", fit_rows, F.lit(True), label_col)
    ids = ids.select(F.col(id_col).alias("_label_id"), (F.col(label_col) > 0).cast("int").alias("toxic"))
    # fit_rows ids at most, so the broadcast is bounded
    rows = documents.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), F.col(id_col) == F.col("_label_id"))
    rows = written(rows.select("text", "toxic").dropDuplicates(), "labelled")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        share = sizes.get(1, 0) / max(1, sum(sizes.values()))
        return Model(intercept=60.0 if share == 1 else -60.0)
    counts = rows.mapInArrow(_count, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n"))
    counts = written(counts, "counts")
    n_t, n = counts.agg(F.sum("t"), F.sum("n")).first()
    n_c = n - n_t
    mass = PRIOR * n
    prior = F.col("n") * PRIOR
    t, c = F.col("t") + prior, F.col("n") - F.col("t") + prior
    odds = F.log(t / (n_t + mass - t)) - F.log(c / (n_c + mass - c))
    z = odds / F.sqrt(1 / t + 1 / c)
    best = counts.where(F.col("t") >= MIN_DOCUMENTS).select("feature", "t", "n", odds.alias("w"), z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_TOKENS).collect()
    model = Model({r.feature: r.w for r in best})
    whole = [r for r in best if not r.feature.endswith("*")]
    rate = min(0.5, sum(r.t for r in whole) / n_t) if whole else 0.0
    model.neutral = min(-1e-3, math.log1p(-rate))
    get = shipped(model, Model.prepared)

    def surprise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = get()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([m.read(x)[0] for x in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic")], ["x", "toxic"])

    got = rows.mapInArrow(surprise, "x double, toxic int").toArrow()  # fit_rows rows at most
    model.intercept, model.slope = logistic(got["x"].to_numpy(), got["toxic"].to_numpy())
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge; the slope is never negative."""
    scale = max(1e-9, float(np.std(x)))
    a = np.stack([np.ones(len(x)), x / scale], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0.0, beta[1] / scale))


def _scorer(model: Model) -> Callable[[Column], Column]:
    get = shipped(model, Model.prepared)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = get()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for text in batch.to_pylist():
                x, found = m.read(text)
                scores.append(m.score(x))
                passages.append([{"start": s, "stop": e, "score": v} for s, e, v in found])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(passages, kind)], ["score", "segments"])
        give_back()

    return F.arrow_udf(run, f"score double, segments {_SEGMENTS}")


def toxicity(documents: DataFrame, model: Model, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """The input with a struct column ``into``: score and segments (token spans with their scores)."""
    return documents.withColumn(into, _scorer(model)(F.col(text_col).cast("string")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity(documents.select("doc_id", "text"), fit(documents, labels))
    score = F.col("toxicity.score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"), (score >= CUT).cast("int").alias("predicted"))
