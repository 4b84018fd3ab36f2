"""Near-duplicate documents at a similarity of their word shingles, by the fingerprints of operator 4.

A whole-text fingerprint links what operator 4 links, two bits or fewer.  At a similarity of 0.8 fingerprints differ in
up to about 14 bits, where no grid on segment popcounts prunes; farther pairs therefore meet on shared shingles, by the
prefix filter (Xiao et al., "Efficient similarity joins for near duplicate detection"), which misses no pair at any
length.  All texts order their distinct shingles alike, common ones last: a pair at the similarity has its first common
shingle in the first fifth of both, and what is left from there on must be able to hold the overlap.  The order comes
from a sample of the texts; results don't depend on it.  A met pair is first held against an upper bound of its overlap,
the sum over hash buckets of the smaller of the two texts' counts; only pairs that could reach the similarity fetch
their shingle sets, and the exact Jaccard similarity of these decides.  Nothing is estimated.

Texts that share a shingle are first compared with the one of them whose hash is least.  Where many pairs of such texts
would still lie between components, they are compared with a few further ones, drawn for each shingle anew, for as long
as that halves those pairs.  Then the pairs that are not yet in one component are compared too, so that no pair hangs on
the choice of the ones.  A group of copies costs rows in proportion to its distinct texts; pairs are listed only between
components, where lengths and places allow the similarity.  Texts of such large shingle groups carry the parities of
their counts in PARITIES buckets: every bucket in which two parities differ holds a shingle that only one of the texts
has, so a pair is listed only where these are few enough for the similarity.

Defined cases: null and blank texts have no shingle, so they are copies of each other; texts of fewer words than a
shingle have one; repeated rows and rows that repeat an id are rows of their own; a null id orders before all others and
comes back as null; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragscore.llm.common import NULL_ID, components, forget, order_id, tidy, written
from ragscore.llm.op4 import near_fingerprints
from ragscore.llm.shipping import give_back, shipped

SHINGLE = 5
SIMILARITY = 0.8
#: One text in SAMPLE tells which shingles are common, at most COMMON of them. Results don't depend on it.
SAMPLE, COMMON = 16, 50_000
#: Buckets of a text's counts, a power of two near its number of shingles. Results don't depend on it.
BUCKETS = 4096
#: Longs whose bits are the parities of a text's counts in as many buckets. Results don't depend on it.
PARITIES = 8
#: Shingles that a worker holds before it sends them on.
GROUP = 1 << 20
#: Texts that are described at once.
ROWS = 512
#: Pairs between components for each text of a shingle, beyond which its texts meet as many drawn ones first. Results don't depend on it.
PAIRS = 8
#: Slack for bounds that are computed in floating point.
_LESS = 1e-9
_U = np.uint64


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles in order; fewer words than a shingle give one of all words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, _U)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.array([digest(join(g), 42) for g in grams], _U)


def _print(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 16):
        part = hashes[s : s + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _node(distinct: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(distinct.tobytes(), 42)


def prefix(distinct: np.ndarray, common: np.ndarray, place: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles of which a text at the similarity must share one; common: sorted, place: their order."""
    n = len(distinct)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
        rank = np.where(common[at] == distinct, place[at], 0)
    return distinct[np.argsort(rank, kind="stable")][: n - math.ceil(similarity * n - _LESS) + 1]


def buckets(distinct: np.ndarray) -> bytes | None:
    """How many shingles fall into each hash bucket, a byte each; None where a count passes a byte."""
    counts = np.bincount((distinct & _U(min(BUCKETS, 1 << len(distinct).bit_length()) - 1)).astype(np.int64))
    return None if len(counts) and counts.max() > 255 else counts.astype(np.uint8).tobytes()


def parities(distinct: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITIES buckets: whether an odd number of shingles falls into it."""
    counts = np.bincount((distinct % _U(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


def most_shared(a: bytes | None, b: bytes | None, n: int, m: int) -> int:
    """An upper bound of the shingles that texts of n and m shingles share, from their bucket counts."""
    if a is None or b is None:
        return min(n, m)
    x, y = (np.frombuffer(c, np.uint8).astype(np.int32) for c in (a, b))
    size = min(BUCKETS, 1 << min(n, m).bit_length())
    x, y = (np.pad(c, (0, -len(c) % size)).reshape(-1, size).sum(0) for c in (x, y))
    return int(np.minimum(x, y).sum())


def _describe(shingle: int, similarity: float, common: np.ndarray, place: np.ndarray):
    get = shipped((common, place))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = get()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, max(1, len(b)), ROWS)):
            fp, node, size, first, marks, odd = [], [], [], [], [], []
            for t in batch.cast(pa.binary()):
                hashes = shingle_hashes(t.as_py() or b"", shingle)
                distinct = np.unique(hashes)
                fp.append(_print(hashes))
                node.append(_node(distinct))
                size.append(len(distinct))
                first.append(prefix(distinct, *known, similarity).view(np.int64))
                marks.append(buckets(distinct))
                odd.append(parities(distinct))
            longs = [pa.array(np.array(x, _U).view(np.int64)) for x in (fp, node)]
            yield pa.StructArray.from_arrays([*longs, pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(odd, pa.list_(pa.int64()))], ["fp", "node", "n", "prefix", "marks", "odd"])
        give_back()

    return F.arrow_udf(run, "fp long, node long, n int, prefix array<long>, marks binary, odd array<long>")


def _can_reach(similarity: float):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for a, b, n, m in batches:
            sizes = zip(a, b, n.to_pylist(), m.to_pylist(), strict=True)
            yield pa.array([most_shared(x.as_py(), y.as_py(), i, j) * (1 + similarity) >= (i + j) * similarity - _LESS for x, y, i, j in sizes], pa.bool_())

    return F.arrow_udf(run, "boolean")


def _sets(shingle: int):
    """A text's node and all its distinct shingles; rows leave in groups of bounded size."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            node, found, held = [], [], 0
            for at, t in enumerate(batch.cast(pa.binary())):
                x = np.unique(shingle_hashes(t.as_py() or b"", shingle))
                node.append(_node(x))
                found.append(x.view(np.int64))
                held += len(x)
                if held > GROUP or at + 1 == len(batch):
                    yield pa.StructArray.from_arrays([pa.array(np.array(node, _U).view(np.int64)), pa.array(found, kind)], ["node", "shingles"])
                    node, found, held = [], [], 0
        give_back()

    return F.arrow_udf(run, "node long, shingles array<long>").asNondeterministic()  # so that it is not run once more in a filter


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample of (_order, text), sorted, and their places in the order, rare ones first.

    Those that occur more than c times, c being the least number that at most COMMON of them pass.
    """
    some = texts.where(F.pmod(F.xxhash64("_order"), F.lit(SAMPLE)) == 0)
    counts = some.select(F.explode(_sets(shingle)("text")["shingles"]).alias("h")).groupBy("h").count().where("count > 2")
    counts = written(counts, "common")
    many = counts.groupBy("count").agg(F.count("*").alias("n"))
    passed = many.select("count", F.sum("n").over(Window.orderBy(F.desc("count"))).alias("upto")).where(F.col("upto") <= COMMON)
    least = passed.agg(F.min("count")).first()[0]
    rows = counts.where(F.col("count") >= least).orderBy("count", "h").collect() if least else []
    found = np.array([r.h for r in rows], np.int64).view(_U)
    order = np.argsort(found)
    forget(counts)
    return found[order], (1 + np.arange(len(rows)))[order]


def _may_reach(n: Column, rest: Column, m: Column, other: Column, similarity: float) -> Column:
    """Whether texts of n and m shingles, rest and other of them left from a first common one on, can reach the similarity."""
    return F.least(rest, other) >= (n + m) * (similarity / (1 + similarity)) - _LESS


def _few_differ(n: Column, m: Column, similarity: float) -> Column:
    """Whether texts of n and m shingles and of parities odd0, odd1, ... and by0, by1, ... can reach the similarity."""
    differ = sum((F.bit_count(F.col(f"odd{i}").bitwiseXOR(F.col(f"by{i}"))) for i in range(1, PARITIES)), F.bit_count(F.col("odd0").bitwiseXOR(F.col("by0"))))
    return differ <= (n + m) * ((1 - similarity) / (1 + similarity)) + _LESS


def near_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: the id, component_id (smallest id of its group), kept (whether it is that row)."""
    source = documents.select(F.col(id_col), order_id(id_col).alias("_order"), F.col(text_col).cast("string").alias("text"))
    told = _describe(shingle, similarity, *_common(source, shingle))(F.col("text")).alias("told")
    rows = written(source.select(F.col(id_col).alias("_id"), "_order", F.monotonically_increasing_id().alias("_row"), told).select("_id", "_order", "_row", "told.*"), "described")
    first = rows.groupBy("node").agg(F.min(F.struct("_order", "_row")).alias("first")).select(F.col("first._order").alias("low"), F.col("first._row").alias("_row"))
    texts = written(rows.select("_row", "node", "fp", "n", "prefix", "marks", "odd").join(first, "_row").drop("_row"), "texts")
    rows = rows.select("_id", "_order", "node")

    part = texts.select("node", "n", F.posexplode("prefix").alias("at", "token")).select("token", "node", "n", (F.col("n") - F.col("at")).alias("rest"))
    alike = Window.partitionBy("token")
    met = written(part.select("*", F.min("node").over(alike).alias("lo"), F.max("node").over(alike).alias("hi")).where("lo <> hi").drop("hi"), "met")
    tidy(documents.sparkSession)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) whose whole shingle sets reach the similarity."""
        marks = texts.select("node", "n", "marks")
        both = pairs.join(marks.toDF("u", "un", "um"), "u").join(marks.toDF("v", "vn", "vm"), "v")
        some = written(both.where(_can_reach(similarity)("um", "vm", "un", "vn")).select("u", "v", "un", "vn"), "pairs")
        tidy(documents.sparkSession)
        asked = some.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(texts.select("node", "low"), "node")
        sets = source.join(asked, F.col("_order") == F.col("low")).select("node", _sets(shingle)("text").alias("told"))
        sets = written(sets.where("told.node = node").select("node", "told.shingles").dropDuplicates(["node"]), "sets")
        tidy(documents.sparkSession)
        both = some.join(sets.withColumnsRenamed({"node": "u", "shingles": "a"}), "u").join(sets.withColumnsRenamed({"node": "v", "shingles": "b"}), "v")
        shared = F.size(F.array_intersect("a", "b"))
        near = written(both.where(shared / (F.col("un") + F.col("vn") - shared) >= similarity).select("u", "v"), "near")
        forget(sets)
        return near

    one = met.where("node = lo").select("token", F.col("node").alias("v"), F.col("n").alias("m"), F.col("rest").alias("other"))
    able = _may_reach(F.col("n"), F.col("rest"), F.col("m"), F.col("other"), similarity)
    first = linked(met.where("node <> lo").join(one, "token").where(able).select(F.col("node").alias("u"), "v").distinct())
    prints = texts.groupBy("fp").agg(F.min("node").alias("lo"))
    same = texts.join(prints, "fp").where("node <> lo").select(F.col("node").alias("u"), F.col("lo").alias("v"))
    near = near_fingerprints(prints.select("fp")).withColumnsRenamed({"u": "a", "v": "b"})
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("lo").alias("u")), "a").join(prints.select(F.col("fp").alias("b"), F.col("lo").alias("v")), "b")
    edges = written(first.unionByName(same).unionByName(near.select("u", "v")), "links")

    def parted(group: DataFrame) -> DataFrame:
        """The rows of met whose shingle lies in several components, with these."""
        placed = met.join(group.withColumnRenamed("id", "node"), "node", "left").select("token", "node", "n", "rest", F.coalesce("component", "node").alias("of"))
        open_ = placed.groupBy("token").agg(F.min("of").alias("a"), F.max("of").alias("b")).where("a <> b").select("token")
        return written(placed.join(open_, "token", "left_semi"), "placed")

    def joined(group: DataFrame, pairs: DataFrame) -> DataFrame:
        return components(group.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(pairs))

    odds = [F.get("odd", F.lit(i)).alias(f"odd{i}") for i in range(PARITIES)]
    by_parities = [F.col(f"odd{i}").alias(f"by{i}") for i in range(PARITIES)]
    few = _few_differ(F.col("n"), F.col("m"), similarity)

    def with_parities(part: DataFrame) -> DataFrame:
        return part.join(texts.select("node", *odds), "node")

    def others(part: DataFrame, also: list[Column] = ()) -> DataFrame:
        return part.select("token", F.col("node").alias("v"), F.col("n").alias("m"), F.col("rest").alias("other"), F.col("of").alias("with"), *also)

    group = components(edges)
    placed = parted(group)
    left, times = math.inf, 0
    while True:
        sizes = placed.groupBy("token", "of").agg(F.count("*").cast("double").alias("k")).groupBy("token").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("inner"))
        large = written(sizes.select("token", ((F.col("all") * F.col("all") - F.col("inner")) / 2).alias("pairs"), "all").where(F.col("pairs") > PAIRS * F.col("all")), "large")
        many = large.agg(F.sum("pairs")).first()[0] or 0
        if not many or many > left / 2:
            break
        left, times = many, times + 1
        some = with_parities(placed.join(large.select("token"), "token", "left_semi"))
        by = Window.partitionBy("token").orderBy(F.xxhash64("token", "node", F.lit(times)), "node")
        drawn = some.withColumn("at", F.row_number().over(by)).where(F.col("at") <= PAIRS)
        pairs = some.join(others(drawn, by_parities), "token").where((F.col("of") != F.col("with")) & able & few).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct()
        group = joined(group, linked(pairs))
        forget(placed)
        placed = parted(group)
    # the smaller of a pair has the shingle early enough for a text of its own size
    early = _may_reach(F.col("n"), F.col("rest"), F.col("n"), F.col("rest"), similarity)
    apart = (F.col("n") <= F.col("m")) & (F.col("of") != F.col("with")) & (F.col("node") != F.col("v")) & able
    pair = [F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")]
    small = placed.join(large.select("token"), "token", "left_anti")
    rest = small.where(early).join(others(small), "token").where(apart).select(*pair)
    some = with_parities(placed.join(large.select("token"), "token", "left_semi"))
    rest = rest.unionByName(some.where(early).join(others(some, by_parities), "token").where(apart & few).select(*pair)).distinct()
    tidy(documents.sparkSession)
    group = joined(group, linked(rest))

    root = texts.join(group, texts.node == group.id, "left").select("node", "low", F.coalesce("component", "node").alias("root"))
    of = root.join(root.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return rows.join(of, "node").select(F.col("_id").alias(id_col), F.when(F.col("component_id") != NULL_ID, F.col("component_id")).alias("component_id"), (F.col("_order") == F.col("component_id")).alias("kept"))
