"""Operator 7: near-duplicate vectors by spherical k-means cells.

Centroids are fitted on a bounded sample (``fit_rows`` vectors by hash order); there are at most a quarter as many.  A
vector lives in the cell of its nearest centroid and is also shown to other cells where a vector linked to it may live;
inside a cell the vectors that live there are compared, block by block, with all that are shown there, so each link of a
vector is counted once, at its home.  Single-precision products only propose pairs; the cosine that decides is computed
in double precision.

A linked x is at most sqrt(2 - 2t) away from y.  For x to live at centroid c while y lives at b, x - y must make up for
(b - c).y, so |x - y| |b - c| cos(angle between the two) >= (b - c).y.  How large that cosine gets depends on the data: in
d dimensions without a preferred direction it is about normal with deviation 1/sqrt(d), where vectors keep to a few
directions it comes near 1.  It is therefore measured, for sampled vectors with their nearest others in the sample and the
centroids around them; its quantile QUANTILE, with MARGIN to spare and no less than ``spread`` deviations, is the bound,
for each vector length by itself.  With ``spread=None`` the angle is not bounded at all, which loses no link (the exact
way, for any data) and shows each vector to more cells.  README.md gives the recall measured against brute force.

Equal vectors are compared once, by their least id and their number.  A cell's vectors are dealt into blocks by hash;
homes of a block meet all blocks shown to the cell, so that no task holds more than two blocks at once.  Each block
emits a spanning forest, not its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, also not with
copies; vectors of different lengths never link; vectors with entries so large or small that their squares leave the
range of doubles are scaled by a power of two first, which changes no cosine; a null id orders before all others; repeated rows count as separate
vectors of one id.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.common import NULL_ID, components, lowest, order_id, written

THRESHOLD = 0.95
FIT_ROWS = 20_000
SPREAD = 3.0
#: Sampled vectors whose nearest others tell the bound of the angle, the quantile that is taken, and what is added to it.
ANGLE_ROWS, QUANTILE, MARGIN = 2000, 0.999, 1.15
#: Centroids around a sampled vector that its angles are measured to.
AROUND = 16
#: Vectors of a cell that one block holds.
BLOCK = 4096
#: Vectors whose similarities to all centroids are held at once.
ROWS = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[s : s + 4096] @ c.T, 1) for s in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-30), c)
    return c


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def widest_cosine(x: np.ndarray, c: np.ndarray, spread: float | None) -> float:
    """A bound of |cos| between the difference of near vectors and that of centroids around them, measured on unit vectors x."""
    d = x.shape[1]
    if spread is None or len(c) < 2 or len(x) < 2:
        return 1.0
    found = []
    some = x[:: max(1, len(x) // ANGLE_ROWS)][:ANGLE_ROWS]
    for s in range(0, len(some), 256):
        y = some[s : s + 256]
        near = y @ x.T
        near[near > 1 - 1e-9] = -2  # itself and its copies
        u = x[near.argmax(1)] - y
        sims = y @ c.T
        around = np.argsort(-sims, axis=1)[:, : AROUND + 1]
        v = c[around[:, 1:]] - c[around[:, :1]]
        length = np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(v, axis=2)
        found.append((np.abs(np.einsum("id,ijd->ij", u, v)) / np.maximum(length, 1e-12)).ravel())
    return float(min(1.0, max(spread / np.sqrt(d), MARGIN * np.quantile(np.concatenate(found), QUANTILE))))


def _assign(models: dict[int, tuple[np.ndarray, float]], threshold: float) -> Callable:
    """models: for each vector length the centroids and the bound of the cosine."""
    away = np.sqrt(max(0.0, 2 - 2 * threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                of = np.flatnonzero(dims == d)
                for at in np.split(of, range(ROWS, len(of), ROWS)):
                    part = batch.take(pa.array(at))
                    x = _matrix(part.column("vec"))
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    c, widest = models.get(int(d), (None, 1.0))
                    sims = x @ c.T if c is not None else np.zeros((len(x), 1))
                    best = sims.argmax(1)
                    reach = np.zeros((len(x), 1))
                    if c is not None:
                        homes, home = np.unique(best, return_inverse=True)
                        reach = (away * widest * np.sqrt(np.maximum(0, 2 - 2 * np.clip(c[homes] @ c.T, -1, 1))) + 1e-9)[home]
                    row, cell = np.nonzero(sims.max(1, keepdims=True) - sims <= reach)
                    columns = [part.column(n).take(pa.array(row)) for n in ("id", "n", "vec")]
                    yield pa.RecordBatch.from_arrays([pa.array(cell + (d.astype(np.int64) << 32)), pa.array(cell == best[row]), *columns], ["cell", "home", "id", "n", "vec"])

    return run


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked id with the least id that it reaches inside the block."""
    ids, flat = np.unique(np.r_[u, v], return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    low = np.arange(len(ids))
    while True:
        m = np.minimum(low[a], low[b])
        after = low.copy()
        np.minimum.at(after, low[a], m)
        np.minimum.at(after, low[b], m)
        np.minimum.at(after, a, m)
        np.minimum.at(after, b, m)
        after = after[after]
        if (after == low).all():
            break
        low = after
    move = low != np.arange(len(ids))
    return ids[move], ids[low[move]]


def _compare(threshold: float) -> Callable:
    def run(key, left, right):
        out = pa.schema([("id", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        a, b = _matrix(left["vec"]), _matrix(right["vec"])
        an, bn = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        ia, ib, nb = left["id"].to_numpy(), right["id"].to_numpy(), right["n"].to_numpy()
        fa, fb = (a / an[:, None]).astype(np.float32), (b / bn[:, None]).astype(np.float32)
        links = np.zeros(len(ia), np.int64)
        us, vs = [], []
        for s in range(0, len(fa), 512):
            for r in range(0, len(fb), 4096):
                i, j = np.nonzero(fa[s : s + 512] @ fb[r : r + 4096].T >= threshold - 1e-4)
                i, j = i + s, j + r
                for q in range(0, len(i), 100_000):
                    p, o = i[q : q + 100_000], j[q : q + 100_000]
                    hit = ((a[p] * b[o]).sum(1) / (an[p] * bn[o]) >= threshold) & (ia[p] != ib[o])
                    p, o = p[hit], o[hit]
                    np.add.at(links, p, nb[o])
                    if len(p):
                        u, v = _forest(ia[p], ib[o])
                        us.append(u)
                        vs.append(v)
        if us:
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
        else:
            u = v = np.zeros(0, np.int64)
        some = np.flatnonzero(links)
        return pa.table([np.r_[ia[some], u], np.r_[ia[some], v], np.r_[links[some], np.zeros(len(u), np.int64)]], schema=out)

    return run


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, spread: float | None = SPREAD, fit_rows: int = FIT_ROWS, cells: int | None = None) -> DataFrame:
    """One row per vector: the id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    good = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    most = F.array_max(F.transform(vec, F.abs))
    scale = F.pow(F.lit(2.0), -F.greatest(F.lit(-1000.0), F.floor(F.log2(most))))
    usual = most.between(2.0**-300, 2.0**300)
    vec = F.when(usual, vec).otherwise(F.transform(vec, lambda x: x * scale))
    rows = written(vectors.select(F.col(id_col).alias("_id"), order_id(id_col).alias("order"), F.when(good, vec).alias("vec")), "vectors")
    distinct = rows.where("vec is not null").groupBy("vec").agg(F.min("order").alias("id"), F.count("*").alias("n"))
    distinct = written(distinct.select("id", "n", "vec", F.size("vec").alias("dims")), "distinct")
    total = distinct.count()
    sample = lowest(distinct.select("vec", F.xxhash64("vec").alias("at")), "at", fit_rows, F.lit(True)).select("vec").toArrow()["vec"].to_pylist()
    k = cells or max(1, min(int(np.sqrt(total)), fit_rows // 4))
    models: dict[int, tuple[np.ndarray, float]] = {}
    for d in {len(v) for v in sample}:
        x = np.array([v for v in sample if len(v) == d])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centroids = spherical_kmeans(x, min(k, len(x)))
        models[d] = centroids, widest_cosine(x, centroids, spread)
    shown = distinct.select("dims", "id", "n", "vec").mapInArrow(_assign(models, threshold), "cell long, home boolean, id long, n long, vec array<double>")
    shown = written(shown, "cells")
    size = shown.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).cast("int").alias("hb"), F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("sb")).where("hb > 0")
    sized = shown.join(F.broadcast(size), "cell")  # at most fit_rows / 4 rows for each vector length
    dealt = F.xxhash64("id")
    homes = sized.where("home").select("cell", F.pmod(dealt, F.col("hb")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("j"), "id", "n", "vec")
    others = sized.select("cell", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("i"), F.pmod(dealt, F.col("sb")).cast("int").alias("j"), "id", "n", "vec")
    keys = ("cell", "i", "j")
    left, right = homes.toDF(*keys, "id", "n", "vec"), others.toDF(*keys, "id", "n", "vec")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare(threshold), "id long, v long, links long")
    found = written(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    group = components(found.where("links = 0").select(F.col("id").alias("u"), "v"))
    low = F.coalesce("component", "id")
    per = distinct.join(links, "id", "left").join(group, "id", "left").select("vec", "n", F.coalesce("links", F.lit(0)).alias("links"), low.alias("low"))
    linked = rows.where("vec is not null").join(per, "vec")
    alone = rows.where("vec is null").select(*[F.lit(None).cast(linked.schema[c].dataType).alias(c) if c not in rows.columns else F.col(c) for c in linked.columns])  # no one key holds them all
    out = linked.unionByName(alone).select(
        F.col("_id").alias(id_col),
        F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("low", "order").alias("component_id"),
        (F.coalesce("low", "order") == F.col("order")).alias("kept"),
    )
    return out.withColumn("component_id", F.when(F.col("component_id") != NULL_ID, F.col("component_id")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
