"""Token-level BERTScore: each token is aligned with the most similar token of the other text, by cosine.

Precision is the mean of the best cosines of the response's tokens, recall that of the other text's, F their harmonic
mean.  With IDF weights a token counts ln((n + 1) / (df + 1)), over the n texts that are compared with.

A token embedder is a column function array of tokens -> array of vectors, one for each token (it sees the sequence, so
vectors may depend on context); if it has of_tokens (list of tokens -> matrix), that is used in its place, once for each
distinct token of a batch.  hashed_vectors() is one that needs no model.  Alignment is a blocked matrix product in
Arrow batches that holds at most CELLS similarities; weights meet tokens in Spark, and no sample's matrix leaves a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscore.functions import kernels
from ragscore.functions import text as T
from ragscore.functions.skew import joined_by_key

TokenEmbedder = Callable[[Column], Column]
SCORES = ("precision", "recall", "f1")
#: Similarities that are held at once.
CELLS = 1 << 20
_BEST = pa.struct([("left", pa.list_(pa.float64())), ("right", pa.list_(pa.float64()))])


@lru_cache(maxsize=200_000)
def _digest_vector(token: str) -> np.ndarray:
    return np.frombuffer(hashlib.md5(token.encode()).digest(), np.uint8) - 127.5


def hashed_vectors(tokens: Column) -> Column:
    """A stand-in for a model: the sixteen bytes of a token's md5, centred."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if row is None else [_digest_vector(t) for t in row] for row in batch.to_pylist()], pa.list_(pa.list_(pa.float64())))

    return F.arrow_udf(run, "array<array<double>>")(tokens)


def _units(row: pa.ListScalar) -> np.ndarray:
    """Unit rows of one array of vectors; a vector without length stays zero and is similar to nothing."""
    vectors = row.values
    if vectors is None or not len(vectors):
        return np.zeros((0, 0))
    m = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def best_matches(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a its largest product with a row of b, and the other way round; 0 where the other side is empty."""
    if not len(a) or not len(b):
        return np.zeros(len(a)), np.zeros(len(b))
    left, right = np.empty(len(a)), np.full(len(b), -np.inf)
    step = max(1, cells // len(b))
    for s in range(0, len(a), step):
        block = a[s : s + step] @ b.T
        left[s : s + step] = block.max(1)
        np.maximum(right, block.max(0), out=right)
    return left, right


def _digest_vectors(tokens: list[str]) -> np.ndarray:
    return np.array([_digest_vector(t) for t in tokens], np.float64).reshape(len(tokens), 16)


#: The vectors of distinct tokens, for embedders that do not look at the sequence: alignment then needs no array of vectors.
hashed_vectors.of_tokens = _digest_vectors


def _aligned_tokens(of_tokens: Callable[[list[str]], np.ndarray]) -> Callable:
    """_aligned over arrays of tokens: each distinct token of a batch has its vector once."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for both in batches:
            ends, codes, known = kernels.token_codes(*both)
            m = of_tokens(known.to_pylist())
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            units = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
            out = [np.empty(len(x)) for x in codes]
            for i in range(len(both[0])):
                cut = [slice(e[i], e[i + 1]) for e in ends]
                out[0][cut[0]], out[1][cut[1]] = best_matches(*(units[x[c]] for x, c in zip(codes, cut, strict=True)))
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(x)) for e, x in zip(ends, out, strict=True)], fields=list(_BEST))

    return run


def _aligned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        found = [best_matches(_units(a), _units(b)) for a, b in zip(left, right, strict=True)]
        yield pa.array([{"left": a, "right": b} for a, b in found], _BEST)


def alignments(pairs: DataFrame, key: str, left: Column, right: Column, embed: TokenEmbedder = hashed_vectors, tokens: Callable[[Column], Column] = T.terms) -> DataFrame:
    """key, side (0: left), token, best: the best cosine of each token; a pair without tokens gives no row."""
    rows = pairs.select(key, tokens(F.coalesce(left, F.lit(""))).alias("l"), tokens(F.coalesce(right, F.lit(""))).alias("r"))
    of_tokens = getattr(embed, "of_tokens", None)
    run, sides = (_aligned, [embed(F.col(c)) for c in ("l", "r")]) if of_tokens is None else (_aligned_tokens(of_tokens), ["l", "r"])
    rows = rows.withColumn("best", F.arrow_udf(run, "struct<left:array<double>,right:array<double>>")(*sides))
    side = lambda t, b, n: F.transform(F.arrays_zip(F.col(t).alias("token"), F.col(b).alias("best")), lambda x: F.struct(F.lit(n).alias("side"), x["token"].alias("token"), x["best"].alias("best")))
    return rows.select(key, F.explode(F.concat(side("l", "best.left", 0), side("r", "best.right", 1))).alias("x")).select(key, "x.*")


def inverse_frequency(texts: DataFrame, text: Column, tokens: Callable[[Column], Column] = T.terms) -> DataFrame:
    """token, weight over the rows of texts: ln((n + 1) / (df + 1))."""
    df = texts.select(F.explode(F.array_distinct(tokens(F.coalesce(text, F.lit(""))))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    return df.join(F.broadcast(n)).select("token", "df", F.ln((F.col("n") + 1) / (F.col("df") + 1)).alias("weight"))  # n is one row


def bert_score(pairs: DataFrame, key: str, left: Column, right: Column, embed: TokenEmbedder = hashed_vectors, idf: bool = False, tokens: Callable[[Column], Column] = T.terms) -> DataFrame:
    """key, precision, recall, f1 for each pair; 0 where a side has no tokens or no weight. A null text counts as empty."""
    found = alignments(pairs, key, left, right, embed, tokens)
    weight = F.lit(1.0)
    if idf:
        weights = inverse_frequency(pairs, right, tokens)
        found = joined_by_key(found, weights, "token", "df")
        seen = F.broadcast(pairs.agg(F.count("*").alias("_n")))  # one row; a token that no text on the right has weighs as df 0
        found = found.join(seen)
        weight = F.coalesce("weight", F.ln(F.col("_n") + 1.0))
    sums = found.withColumn("w", weight).groupBy(key, "side").agg(F.sum(F.col("w") * F.col("best")).alias("s"), F.sum("w").alias("w"))
    of = lambda n: F.coalesce(F.max(F.when((F.col("side") == n) & (F.col("w") > 0), F.col("s") / F.col("w"))), F.lit(0.0))
    both = pairs.select(key).join(sums.groupBy(key).agg(of(0).alias("precision"), of(1).alias("recall")), key, "left").fillna(0.0, ["precision", "recall"])
    total = F.col("precision") + F.col("recall")
    return both.select(key, "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)).alias("f1"))


def pair_score(embed: TokenEmbedder = hashed_vectors, kind: str = "f1", idf: bool = False) -> Callable[[DataFrame, str, Column, Column], DataFrame]:
    """A scorer of pairs of texts: (pairs, key, left, right) -> key, score."""
    if kind not in SCORES:
        raise ValueError(f"unknown score {kind}")
    return lambda pairs, key, left, right: bert_score(pairs, key, left, right, embed, idf).select(key, F.col(kind).alias("score"))


def mean_scores(samples: DataFrame, compare_to: str = "reference", embed: TokenEmbedder = hashed_vectors, idf: bool = False, key: str = "sample_id") -> DataFrame:
    """metric, value, num_samples for precision, recall and F; samples whose other text is null or empty are skipped."""
    rows = samples.where(F.col(compare_to).isNotNull() & (F.col(compare_to) != ""))
    scores = bert_score(rows, key, F.col("response"), F.col(compare_to), embed, idf)
    means = scores.agg(F.count("*").alias("num_samples"), *[F.round(F.coalesce(F.avg(s), F.lit(0.0)), 6).alias(s) for s in SCORES])
    out = means.unpivot(["num_samples"], list(SCORES), "metric", "value")
    return out.select(F.concat(F.lit("bertscore_"), "metric", F.lit(f"_{compare_to}{'_idf' if idf else ''}")).alias("metric"), "value", "num_samples")
