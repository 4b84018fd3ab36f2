"""Top-k by blocks: queries and documents are dealt into blocks, and each pair of blocks is a task's matrix product.

No key of the data decides where work goes, so a term that every document has, or a region that holds most vectors, is
split like any other; a task sends at most k rows a query on.  Documents are sent once for each block of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 256
DOCUMENT_BLOCK = 2048
#: Postings whose products with a block of queries are held at once.
POSTINGS = 8192
#: Vectors that stand for the regions of a vector space.
PIVOTS = 64
DIGITS = 1e9
#: dots (documents x queries), sizes of the queries, sizes of the documents -> scores
Score = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def cosine(dots: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    return dots / (d[:, None] * q[None, :])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    return np.diff(whole.offsets.to_numpy()), whole.flatten()


def _first(scores: np.ndarray, there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each column among those that are there, ties (to nine digits) to earlier rows."""
    told = np.where(there, np.floor(scores * DIGITS + 0.5), -np.inf)
    if len(told) > k:
        told = np.where(told >= np.partition(told, len(told) - k, axis=0)[len(told) - k], told, -np.inf)
    row, column = np.nonzero(told > -np.inf)
    order = np.lexsort((row, -told[row, column], column))
    row, column = row[order], column[order]
    rank = np.arange(len(column)) - np.searchsorted(column, column)
    return row[rank < k], column[rank < k]


def _sparse(k: int, score: Score, names: tuple[str, str]) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(names[0], left.schema.field("id").type), (names[1], right.schema.field("id").type), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.take(pc.sort_indices(right["id"]))
        n, flat = _lists(left["terms"])
        vocabulary = pc.unique(flat)
        weight = np.zeros((len(vocabulary), len(n)))
        weight[pc.index_in(flat, vocabulary).to_numpy(), np.repeat(np.arange(len(n)), n)] = _lists(left["weights"])[1].to_numpy()
        m, postings = _lists(right["terms"])
        code = pc.index_in(postings, vocabulary)
        known = np.flatnonzero(np.asarray(code.is_valid()))
        code, doc = code.take(pa.array(known)).to_numpy(), np.repeat(np.arange(len(m)), m)[known]
        w = _lists(right["weights"])[1].to_numpy()[known]
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        q, d = left["size"].to_numpy(), right["size"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(starts, starts[at] + POSTINGS)))
            lo, hi = starts[at], starts[upto] if upto < len(starts) else len(doc)
            dots = np.zeros((upto - at, len(n)))
            for s in range(lo, hi, POSTINGS):  # one document may hold more than a step
                e = min(hi, s + POSTINGS)
                cuts = np.unique(np.r_[s, starts[at:upto][(starts[at:upto] >= s) & (starts[at:upto] < e)]])
                dots[np.searchsorted(starts[at:upto], cuts, "right") - 1] += np.add.reduceat(weight[code[s:e]] * w[s:e, None], cuts - s, axis=0)
            rows = doc[starts[at:upto]]
            values = score(dots, q, d[rows])
            r, c = _first(values, dots > 0, k)
            found.append((rows[r], c, values[r, c]))
            at = upto
        if not found:
            return schema.empty_table()
        rows, c, values = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rows, -np.floor(values * DIGITS + 0.5), c))
        order = order[np.arange(len(order)) - np.searchsorted(c[order], c[order]) < k]
        return pa.table([left["id"].take(pa.array(c[order])), right["id"].take(pa.array(rows[order])), pa.array(values[order])], schema=schema)

    return run


def _dealt(n: int, size: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // size)))).cast("int")


def sparse_top_k(queries: DataFrame, documents: DataFrame, k: int, score: Score, names: tuple[str, str], n_queries: int, n_documents: int) -> DataFrame:
    """names[0], names[1], score: for each query the k best documents of each block that share a term with it.

    Both tables have id, terms, weights (for each distinct term) and size, which score reads. The numbers of rows only
    decide how many blocks there are.
    """
    qb = max(1, -(-n_queries // QUERY_BLOCK))
    left = queries.select("id", "terms", "weights", "size", _dealt(n_queries, QUERY_BLOCK).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n_documents // DOCUMENT_BLOCK)) - 1))).alias("j"))
    right = documents.select("id", "terms", "weights", "size", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("i"), _dealt(n_documents, DOCUMENT_BLOCK).alias("j"))
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, documents)]
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_sparse(k, score, names), f"{names[0]} {kinds[0]}, {names[1]} {kinds[1]}, score double")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _placed(pivots: np.ndarray) -> Callable:
    """Unit vectors with their nearest pivot and the angle to it; those of another length than the pivots' drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column("vec")), pivots.shape[1]), False)
            batch = batch.filter(fits)
            x = _matrix(batch.column("vec")) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            whole = np.isfinite(x).all(1)
            x, ids = x[whole], batch.column("id").filter(pa.array(whole))
            x = x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-12)
            near = x @ pivots.T
            cell = near.argmax(1) if len(x) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * pivots.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([ids, vec, pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "vec", "cell", "angle"])

    return run


def _products(k: int) -> Callable:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.schema.field("id").type
        schema = pa.schema([("query_id", kind), ("found", kind), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.take(pc.sort_indices(right["id"]))
        q, d = _matrix(left["vec"]), _matrix(right["vec"])
        codes = pc.index_in(left["id"], right["id"].combine_chunks()).to_numpy(zero_copy_only=False)
        values = d @ q.T
        there = np.ones(values.shape, bool)
        own = np.flatnonzero(~np.isnan(codes.astype(np.float64)))
        for c in own:  # every row of the query's own id
            r = int(codes[c])
            while r < len(d) and right["id"][r] == left["id"][int(c)]:
                there[r, c] = False
                r += 1
        r, c = _first(values, there, k)
        return pa.table([left["id"].take(pa.array(c)), right["id"].take(pa.array(r)), pa.array(values[r, c])], schema=schema)

    return run


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int, block: int = DOCUMENT_BLOCK) -> DataFrame:
    """query_id, found, score (cosine): the k best other vectors of each query in each block that may hold one of its k best.

    Both tables have id and vec. Vectors lie in the region of their nearest pivot (PIVOTS of the corpus, by hash). No
    vector of a region is closer to a query than its pivot's angle less the region's widest angle: regions whose bound
    stays below the k-th best of a first block, the query's own region's, are left out. The bound is exact.
    """
    # a sample of pivots by hash: each partition sends PIVOTS rows at most
    rows = [r.vec for r in corpus.where("vec is not null and size(vec) > 0").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select(F.col("vec").cast("array<double>").alias("vec")).collect()]
    width = max((len(v) for v in rows), key=[len(v) for v in rows].count, default=1)
    pivots = np.nan_to_num(np.array([[0.0 if x is None else x for x in v] for v in rows if len(v) == width] or [[1.0] * width], np.float64))
    pivots /= np.sqrt((pivots * pivots).sum(1, keepdims=True)) + 1e-12
    kind = corpus.schema["id"].dataType.simpleString()
    placed = lambda df: df.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_placed(pivots), f"id {kind}, vec array<double>, cell int, angle double")
    c, q = placed(corpus), placed(queries)
    regions = c.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("subs"), F.max("angle").alias("radius"))  # a row for each pivot
    c = c.join(F.broadcast(regions), "cell").select("id", "vec", "cell", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias("sub"))
    n = queries.count()
    dealt = _dealt(n, QUERY_BLOCK)
    c = c.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // QUERY_BLOCK)) - 1))))
    keys = ("cell", "sub", "i")

    def compared(q: DataFrame) -> DataFrame:
        return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(_products(k), f"query_id {kind}, found {kind}, score double")

    home = compared(q.select("id", "vec", "cell", F.lit(0).alias("sub"), dealt.alias("i")))
    least = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec")) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            a = np.arccos(np.clip(x @ pivots.T, -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots)), pa.array(a.ravel()))], ["id", "vec", "angles"])

    far = q.select("id", "vec").mapInArrow(angles, f"id {kind}, vec array<double>, angles array<double>")
    far = far.join(least.withColumnRenamed("query_id", "id"), "id", "left").select("id", "vec", "least", F.posexplode("angles").alias("cell", "to"))
    bound = F.cos(F.greatest(F.lit(0.0), F.col("to") - F.col("radius"))) + 1e-8  # a little more, for the last digits
    far = far.join(F.broadcast(regions), "cell").where(F.col("least").isNull() | (bound >= F.col("least")))
    return compared(far.select("id", "vec", "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), dealt.alias("i")))
