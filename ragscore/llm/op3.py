"""Operator 3: best-fit packing of token sequences with large-item matching.

Only documents longer than a sequence are cut.  Pieces over a third of the capacity fit at most twice into a sequence:
the largest one left opens a sequence and is matched with the largest other that still fits; smaller pieces then fill
the gap, best fit first, and what is left of them is packed the same way.

The packing depends on lengths alone, so it is planned on the histogram of lengths, which has as many rows as the
capacity whatever the input.  A plan is a list of patterns (how many pieces of which lengths) with repetitions; each
pattern uses up at least one of its lengths as far as it can.  Pieces then look up their place: the rank of a piece among
those of its length, counted per bucket of about RANK_ROWS rows so that a common length is not ranked in one task,
falls into one run of a pattern.

Defined cases: null text counts as empty and gives its end id alone; repeated rows and rows that share an id are packed
as pieces of their own; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragscore.llm import op5
from ragscore.llm.common import written

CAPACITY = 4096
END_ID = 1
RANK_ROWS = 1000
_PIECES = "row long, piece int, start long, length long, ids_crc32 long"


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, pieces of it in a sequence, offset) for counts of lengths 0 .. capacity."""
    left = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, ...]] = []
    sequence = 0
    small = capacity // 3

    def largest(low: int, high: int) -> int:
        """The largest length in (low, high] that is left, or 0."""
        found = np.flatnonzero(left[low + 1 : high + 1])
        return low + 1 + int(found[-1]) if len(found) else 0

    while left[1:].any():
        taken: dict[int, int] = {}
        gap = capacity
        first = largest(small, capacity) or largest(0, small)
        taken[first] = 1
        gap -= first
        if first > small:
            left[first] -= 1
            second = largest(small, gap)
            left[first] += 1
            if second:
                taken[second] = taken.get(second, 0) + 1
                gap -= second
        ceiling = min(gap, small)
        while gap and (size := largest(0, min(gap, ceiling))):
            many = min(int(left[size]) - taken.get(size, 0), gap // size)
            if many:
                taken[size] = taken.get(size, 0) + many
                gap -= many * size
            ceiling = size - 1
        repeat = min(int(left[size]) // many for size, many in taken.items())
        offset = 0
        for size, many in taken.items():
            runs.append((size, int(used[size]), repeat * many, sequence, many, offset))
            used[size] += repeat * many
            left[size] -= repeat * many
            offset += size * many
        sequence += repeat
    return np.array(runs, np.int64).reshape(-1, 6)


def cut(ids: np.ndarray, capacity: int, end_id: int) -> list[np.ndarray]:
    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
    return [ids[s : s + capacity] for s in range(0, len(ids), capacity)]


def _pieces(path: str, capacity: int, end_id: int) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = op5.load(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                packed = bpe.packed(text or "") + end
                for k, s in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[s : s + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def _place(runs: np.ndarray) -> Callable:
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    size, first, _, sequence, many, offset = runs[order].T
    shift = np.int64(1 << 48)
    starts = size * shift + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(starts, length * shift + rank, "right") - 1
            within = rank - first[at]
            columns = [batch.column(n) for n in ("id", "piece", "start", "length", "ids_crc32")]
            places = [pa.array(sequence[at] + within // many[at]), pa.array(offset[at] + within % many[at] * length)]
            yield pa.RecordBatch.from_arrays([*columns, *places], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def best_fit_pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or op5.default_path()
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    head = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = written(texts.mapInArrow(_pieces(path, capacity, end_id), head), "pieces")
    histogram = pieces.groupBy("length").count().collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    runs = plan(counts, capacity)
    buckets = max(1, int(counts.sum()) // RANK_ROWS)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("within", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")))
    ranked = ranked.join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within") - 1)
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(runs), f"{head}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def sequences(documents: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """sequence_id and input_ids of every sequence of best_fit_pack; ids must be unique."""
    path = path or op5.default_path()
    ids = F.concat(op5.encode(path)(F.col(text_col).cast("string")), F.array(F.lit(end_id)))
    tokens = documents.select(id_col, ids.alias("_ids"))
    part = F.expr(f"slice(_ids, cast(start + 1 as int), {capacity})")
    joined = placed.join(tokens, id_col).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", part.alias("ids")))).alias("parts"))
    return joined.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("input_ids"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
