"""Operator 2: exact top-k by integer inner product, columnar branch-and-bound.

Components become floor(256 x).  Queries and candidates are dealt into blocks of bounded size and every block of
queries meets every block of candidates in a task of its own; nothing is broadcast.  In a task the candidates lie in
vertical layout, a row for each dimension.  Scores grow dimension block by dimension block; after each, a candidate
whose score plus the largest value that the remaining dimensions can add (the product of the remaining norms) stays
below the query's k-th best guaranteed score is dropped, and the survivors are compacted.  All sums are integers below
2**53, so double precision is exact; a task whose values could exceed that uses Python's integers.  A score beyond 64
bits is held at that end of the range, and ties there go to smaller ids like any other.

Defined cases: vectors that are null or hold null or non-finite components (or such once times 256) take no part; an empty vector scores 0;
vectors of different lengths are compared as if the shorter ended in zeros; fewer than k other rows give all of them;
repeated ids are separate rows, a query skips rows of its own id; rows with a null id take no part; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 5
QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 8192
#: Dimensions added between two prunings.
DIMENSIONS = 16
_MOST = (1 << 63) - 1
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _padded(table: pa.Table, width: int) -> np.ndarray:
    lists = table["vec"].combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(n), width))
    flat = lists.flatten().to_numpy()
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _kth(values: np.ndarray, k: int) -> float:
    return -np.inf if len(values) < k else np.partition(values, len(values) - k)[len(values) - k]


def branch_and_bound(queries: np.ndarray, columns: np.ndarray, own: list[np.ndarray], k: int, block: int = DIMENSIONS):
    """Yields (query, surviving candidates, their exact scores); columns has one row per dimension. own: candidates that a query skips."""
    dims, n = columns.shape
    cuts = list(range(0, dims, block)) + [dims]
    rest_c = [np.sqrt((columns[c:] ** 2).sum(0)) for c in cuts]
    for q, vector in enumerate(queries):
        alive = np.arange(n)
        if len(own[q]):
            alive = np.delete(alive, own[q])
        score = np.zeros(len(alive))
        for b in range(len(cuts) - 1):
            lo, hi = cuts[b], cuts[b + 1]
            score += vector[lo:hi] @ (columns[lo:hi] if len(alive) == n else columns[lo:hi][:, alive])
            if hi == dims or len(alive) <= k:
                continue
            slack = np.sqrt((vector[hi:] ** 2).sum()) * rest_c[b + 1][alive]
            top = np.argpartition(score, len(score) - k)[-4 * k :] if len(score) > 4 * k else np.arange(len(score))
            sure = _kth(score - slack, k)
            full = score[top] + vector[hi:] @ columns[hi:][:, alive[top]]  # the leaders' true scores bound the rest
            bar = max(sure, _kth(full, k)) - 1e-6 * (1 + abs(slack).max())
            live = score + slack >= bar
            alive, score = alive[live], score[live]
        yield q, alive, score


def _task(k: int) -> Callable:
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _OUT.empty_table()
        width = max(int(np.diff(t["vec"].combine_chunks().offsets.to_numpy()).max()) for t in (left, right)) or 1
        q, c = _padded(left, width), _padded(right, width)
        qi, ci = left["id"].to_numpy(), right["id"].to_numpy()
        order = np.argsort(ci, kind="stable")
        at = [order[np.searchsorted(ci[order], i) : np.searchsorted(ci[order], i, "right")] for i in qi]
        if np.abs(q).max() * np.abs(c).max() * width >= 2**53:
            exact = [[int(x) for x in v] for v in c]
            found = ((i, np.setdiff1d(np.arange(len(c)), at[i]), v) for i, v in enumerate(q))
            found = ((i, r, np.array([max(-_MOST - 1, min(_MOST, sum(int(a) * b for a, b in zip(v, exact[j], strict=True)))) for j in r], np.int64)) for i, r, v in found)
        else:
            found = branch_and_bound(q, np.ascontiguousarray(c.T), at, k)
        out: list[list[np.ndarray]] = [[], [], []]
        for i, rows, score in found:
            best = np.lexsort((ci[rows], ~score if score.dtype == np.int64 else -score))[:k]
            for o, v in zip(out, (np.full(len(best), qi[i]), ci[rows[best]], score[best].astype(np.int64)), strict=True):
                o.append(v)
        return pa.table([np.concatenate(o) for o in out], schema=_OUT)

    return run


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each query, ties to smaller ids."""
    spark = candidates.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        vec = F.col(vec_col).cast("array<double>")
        whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < float("inf")))
        vec = F.transform(vec, lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * 256).cast("double")).otherwise(x * 256))  # whole above
        return df.where(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))

    q, c = clean(queries), clean(candidates)
    sizes = [df.agg(F.count("*")).first()[0] for df in (q, c)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    qb = max(1, -(-sizes[0] // QUERY_BLOCK))
    cb = max(1, -(-sizes[1] // CANDIDATE_BLOCK), min(-(-parts // qb), -(-sizes[1] // 512)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = q.select("id", "vec", deal(qb).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("j"))
    right = c.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("i"), deal(cb).alias("j"))
    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_task(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors.where("vec_id % 50 = 0"), vectors)


OP2_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5
"""

OP7_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
