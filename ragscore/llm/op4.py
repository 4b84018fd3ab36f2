"""Operator 4: SimHash near-dedup by segment popcounts.

A 64-bit fingerprint is mapped to the bit counts of its segments, twenty of 3 bits and one of 4.  Fingerprints that differ in d bits have
count vectors at Manhattan distance d or less, so vectors within distance 2 are a superset of the links.  The range join
runs on the integer grid: each distinct fingerprint enters its own cell and the 42 cells one step away; two vectors
within distance 2 share one of these cells.  Fingerprints that meet nobody are done.  The others are verified exactly
and without listing pairs: fingerprints link at 2 or fewer bits if and only if they share a number at 1 or fewer bits
from both, so each sends its 65 such numbers and links to the smallest fingerprint that sent the same one.  A group of any
size costs rows in proportion to its distinct fingerprints; copies share one.

Defined cases: null or blank text has fingerprint zero and links like any other; fewer words than a shingle give one
shingle of all words; repeated rows share a fingerprint and so a component; a null id orders before all others; only id
and text are read, columns in ``carry`` go along and give way to the operator's own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.common import NULL_ID, components, met, order_id, written

#: Shingles whose hashes are held at once.
BLOCK = 1 << 16
SEGMENTS = 21
#: The lowest bit of each segment.
_LOWEST = sum(1 << (3 * i) for i in range(SEGMENTS))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half the XXH64 (seed 42) hashes of the shingles, repeats included."""
    words = text.lower().split()  # both act on ASCII only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for s in range(0, n, BLOCK):
        part = words[s : s + BLOCK + shingle - 1]
        grams = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
        packed = b"".join([digest(join(g), 42) for g in grams])
        ones += np.unpackbits(np.frombuffer(packed, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.array(prints.view(np.int64))

    return F.arrow_udf(run, "long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of all segments, each in the bits of its segment; one more fits there, and the sign stays free."""
    ones = [F.shiftrightunsigned(fp, i).bitwiseAND(F.lit(_LOWEST)) for i in range(3)]
    return ones[0] + ones[1] + ones[2] + F.shiftrightunsigned(fp, 3).bitwiseAND(F.lit(1 << 60))


def _cells(prints: DataFrame) -> DataFrame:
    """fp and each grid cell it enters."""
    prints = prints.withColumn("c", segment_counts(F.col("fp")))
    up = [F.col("c") + F.lit(1 << (3 * i)) for i in range(SEGMENTS)]
    width = [7] * (SEGMENTS - 1) + [15]
    down = [F.when(F.shiftrightunsigned("c", 3 * i).bitwiseAND(F.lit(w)) > 0, F.col("c") - F.lit(1 << (3 * i))) for i, w in enumerate(width)]
    return prints.select("fp", F.explode(F.array_compact(F.array("c", *up, *down))).alias("cell"))


def near_fingerprints(prints: DataFrame) -> DataFrame:
    """(u, v): links that join distinct fingerprints fp within 2 bits into their components."""
    cells = _cells(prints)
    shared = cells.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    near = met(cells, shared, "cell", how="left_semi").select("fp").distinct()
    balls = near.select("fp", F.explode(F.array("fp", *[F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(64)])).alias("ball"))
    low = balls.groupBy("ball").agg(F.min("fp").alias("v"), F.max("fp").alias("hi")).where("v <> hi").select("ball", "v")
    return met(balls, low, "ball").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct()


def simhash_near_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, carry: list[str] = ()) -> DataFrame:
    """One row per input row: the id, fingerprint (long), component_id (smallest id reachable), kept (first of its component), carried columns."""
    own = {id_col, "fingerprint", "component_id", "kept"}
    extra = [c for c in carry if c not in own]
    going = F.struct(*[F.col(c) for c in extra]).alias("_carry") if extra else F.lit(0).alias("_carry")
    rows = documents.select(F.col(id_col).alias("_id"), order_id(id_col).alias("_order"), _fingerprints(shingle)(F.col(text_col).cast("string")).alias("fp"), going)
    rows = written(rows, "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("_order").alias("low")), "prints")
    group = components(near_fingerprints(prints.select("fp")))
    root = met(prints, group, prints.fp == group.id, how="left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = root.groupBy("root").agg(F.min("low").alias("component_id"))
    of = met(root, lows, "root").select("fp", "component_id")
    return met(rows, of, "fp").select(
        F.col("_id").alias(id_col),
        F.col("fp").alias("fingerprint"),
        F.when(F.col("component_id") != NULL_ID, F.col("component_id")).alias("component_id"),
        (F.col("_order") == F.col("component_id")).alias("kept"),
        *[F.col("_carry").getField(c).alias(c) for c in extra],
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
