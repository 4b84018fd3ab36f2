"""Operator 12: embedding whitening along leading components that LOBPCG finds without building a covariance matrix.

Entries become whole numbers floor(256 c).  The fit list holds each distinct vector once; its sums S are exact.  A round
of LOBPCG is one pass over the fit list: each task centres its rows, multiplies them with the block of basis columns and
back, and sends a d x q sum on; sums are added by a partial aggregate, and only their total reaches the driver, whose
size follows the vector width d.  The basis holds the iterate, its residuals and the previous directions, each
orthonormal to those before; Rayleigh-Ritz in it gives the next iterate.  As every round multiplies the whole basis
anew, a residual |V v - e v| is that of the vector itself and certifies its eigenvalue; rounds go on until the residuals
of the components asked for are below CERTIFIED times the largest eigenvalue and, beyond that, for as long as they fall.
Twelve columns more than are asked for ride along, so that close eigenvalues behind the last one don't slow it down.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; shorter vectors count as ending
in zeros; entries beyond 64 bits are held at that end of the range, likewise deviations; repeated and null ids are rows
of their own; d below 4 gives d components; a component whose eigenvalue is zero to double precision (as with one
distinct vector) gives whitened null, explained 0 (null where the trace is 0 too) and takes no part in identity_error,
null if none does; where eigenvalues are equal their vectors are some orthonormal basis of the space that they span.
No vector, or only empty ones, gives no row.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.common import written

COMPONENTS = 4
GUARD = 12
#: Residuals over the largest eigenvalue that must be reached, and rounds after which there is no hope of it.
CERTIFIED = 1e-10
ROUNDS = 500
#: Entries of a block of rows that is held as a matrix.
CELLS = 1 << 20
_MOST = (1 << 63) - 1


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, x) of the rows that remain."""
    for batch in batches:
        lists = batch.column("vec")
        there = np.flatnonzero(np.asarray(lists.is_valid()))
        lists = lists.take(pa.array(there))
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        value = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        bad = ~np.isfinite(value) | np.asarray(flat.is_null())
        row = np.repeat(np.arange(len(n)), n)
        keep = np.bincount(row[bad], minlength=len(n)) == 0
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(256 * value)
            x = np.where(scaled >= 2.0**63, _MOST, np.where(scaled < -(2.0**63), -_MOST - 1, np.where(np.abs(scaled) < 2.0**63, scaled, 0).astype(np.int64)))
        stay = np.flatnonzero(keep)
        offsets = np.r_[0, np.cumsum(n[stay])].astype(np.int32)
        x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[keep[row]].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(there[stay])), x], ["id", "x"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their x as an integer matrix of the full width."""
    step = max(1, CELLS // max(1, width))
    for batch in batches:
        for s in range(0, batch.num_rows, step):
            part = batch.slice(s, step)
            lists = part.column("x")
            n = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(n), width), np.int64)
            out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
            yield part, out


def _exact_sums(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, x in _blocks(batches, width):
            if len(x) and np.abs(x.astype(np.float64)).max() * len(x) >= 2.0**62:
                x = x.astype(object)
            total = [a + int(b) for a, b in zip(total, x.sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(t) for t in total])], ["dim", "s"])

    return run


def _summed(fit: DataFrame, mean: np.ndarray, size: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of f(centred block), a vector of ``size`` numbers; tasks add up before anything is sent."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _blocks(batches, width):
            total += f(x - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():  # d x q numbers
        out[r.cell] = r.value
    return out


def orthonormal(block: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the block's part outside the others (which are orthonormal); what vanishes there is left out."""
    norm = np.linalg.norm(block, axis=0)
    block = block[:, norm > 0] / norm[norm > 0]
    for _ in range(2):  # twice is enough
        for o in others:
            block = block - o @ (o.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, want: int, guard: int = GUARD, certified: float = CERTIFIED, rounds: int = ROUNDS, seed: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenvalues, their unit vectors (columns) and residuals of the symmetric matrix behind ``product``."""
    m = min(d, want + guard)
    x = orthonormal(np.random.default_rng(seed).normal(size=(d, m)))
    w = p = np.zeros((d, 0))
    best, stuck = np.inf, 0
    for _ in range(rounds):
        q = np.hstack([x, w, p])
        y = product(q)
        h = q.T @ y
        value, c = np.linalg.eigh((h + h.T) / 2)
        value, c = value[::-1][:m], c[:, ::-1][:, :m]
        old, x = x, q @ c
        off = y @ c - x * value
        residual = np.linalg.norm(off, axis=0)
        scale = max(value[0], 0.0)
        worst = residual[:want].max(initial=0.0)
        stuck = 0 if worst < best / 2 else stuck + 1
        best = min(best, worst)
        if worst <= 4 * np.finfo(float).eps * scale or (worst <= certified * scale and stuck >= 2):
            return value[:want], x[:, :want], residual[:want]
        x = orthonormal(x)[:, :m] if np.abs(x.T @ x - np.eye(m)).max() > 1e-14 else x
        w = orthonormal(off, x)[:, : d - m]
        p = orthonormal(q[:, old.shape[1] :] @ c[old.shape[1] :], x, w)[:, : d - m - w.shape[1]] if q.shape[1] > old.shape[1] else np.zeros((d, 0))
    raise RuntimeError(f"residuals of {worst:g} after {rounds} rounds, {certified * scale:g} is asked for")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining vector and component: id, component, n, deviation, whitened, explained, identity_error, residual."""
    spark = vectors.sparkSession
    out = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = written(rows.mapInArrow(_whole, "id long, x array<long>"), "whole")
    width = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    if not width:
        return spark.createDataFrame([], out)
    padded = F.when(F.size("x") < width, F.concat("x", F.array_repeat(F.lit(0).cast("long"), width - F.size("x")))).otherwise(F.col("x"))
    fit = written(rows.select(padded.alias("x")).distinct(), "fit")
    n = fit.count()
    sums = [0] * width
    for r in fit.mapInArrow(_exact_sums(width), "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        sums[r.dim] = int(r.s)
    mean = np.array([s / n for s in sums])

    def product(q: np.ndarray) -> np.ndarray:
        return _summed(fit, mean, q.size, lambda x: (x.T @ (x @ q)).ravel()).reshape(q.shape) / n

    trace = float(_summed(fit, mean, 1, lambda x: np.array([(x * x).sum()]))[0] / n)
    value, axes, residual = lobpcg(product, width, min(components, width))
    scale = max(value[0], 0.0)
    alive = value > 8 * width * np.finfo(float).eps * scale
    to = axes[:, alive] / np.sqrt(value[alive])
    error = None
    k = to.shape[1]
    if k:
        centre = _summed(fit, mean, k, lambda x: (x @ to).sum(0)) / n
        spread = _summed(fit, mean, k * k, lambda x: ((x @ to - centre).T @ (x @ to - centre)).ravel()) / n
        error = float(np.abs(spread.reshape(k, k) - np.eye(k)).max())
    explained = [float(v) / trace if a else 0.0 for v, a in zip(value, alive, strict=True)] if trace > 0 else [None] * len(value)
    certificate = [float(r / scale) if scale > 0 else 0.0 for r in residual]
    most = max(abs(s) for s in sums)
    exact = np.array(sums, np.int64) if most < 2**62 else None

    def deviations(x: np.ndarray) -> np.ndarray:
        top = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + most
        if exact is not None and top * top * width < 2.0**62:
            return ((n * x - exact) ** 2).sum(1)
        return np.array([min(_MOST, sum((n * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True))) for v in x], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width):
            many = len(value)
            score = np.full((len(x), many), np.nan)
            score[:, alive] = (x - mean) @ to
            again = lambda v: pa.array(v * len(x), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(np.repeat(np.arange(len(x)), many))),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * many, n, np.int64)),
                    pa.array(np.repeat(deviations(x), many)),
                    pa.array(score.ravel(), from_pandas=True),
                    again(explained),
                    again([error] * many),
                    again(certificate),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
            )

    return rows.mapInArrow(run, out)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
