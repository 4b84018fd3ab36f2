"""What the operators share: scratch tables, connected components, small column helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids order rows: before all others.
NULL_ID = -(1 << 63)


#: Paths of the tables that each open scope has written.
_scopes: dict[str, list[str]] = {}
_open: list[str] = []


@contextmanager
def scope(name: str):
    """Notes under ``name`` the tables that are written inside, for release()."""
    _scopes.setdefault(name, [])
    _open.append(name)
    try:
        yield
    finally:
        _open.pop()


def release(spark: SparkSession, name: str) -> None:
    """Deletes the tables of a scope whose results have all been written elsewhere."""
    for path in _scopes.pop(name, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a local one only in local mode, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the scratch folder: computed once, without lineage, safe against lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    if _open:
        _scopes[_open[-1]].append(path)
    return back


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more, and executors hand free heap back.

    An executor's heap grows with every sort and join and is not given back by itself, while Python workers need the
    memory beside it; a task for each executor asks its JVM to collect.
    """
    gc.collect()
    spark._jvm.System.gc()
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()
    spark.range(0, executors, 1, executors).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()  # a row for each


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def lowest(rows: DataFrame, at: str, n: int, also: Column, *ties: str) -> DataFrame:
    """At most n rows of the lowest hashes in the column ``at`` for which ``also`` holds, a sample that is alike each time.

    The rows for which it holds are counted first, and only hashes up to about 1.5 n of them go on, so that no partition
    sends n rows.
    """
    rows = rows.where(also)
    total = rows.select(at).count()
    upto = -(1 << 63) + min((1 << 64) - 1, int((1.5 * n + 500) / max(1, total) * (1 << 64)))
    return rows.where(F.col(at) <= upto).orderBy(at, *ties).limit(n)


def order_id(name: str) -> Column:
    """A long that orders rows by id, nulls first."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def met(left: DataFrame, right: DataFrame, *by: Column | str, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input: shuffled and sorted whatever their sizes on disk seem to be.

    A small file or shuffle of sorted longs unpacks to many times its size, and a broadcast would build it in the driver.
    """
    return left.hint("merge").join(right.hint("merge"), list(by) if isinstance(by[0], str) else by[0], how)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each id in edges (u, v): component is the smallest id reachable.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and beyond"):
    every step is a partial aggregate and an equi-join, so a hub with many neighbours is split like any skewed key.
    Ends when a round changes nothing; the rounds grow with the logarithm of the longest path.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = met(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        up = met(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(up.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        sign = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        forget(now)
        now = after
        if sign == seen:
            break
        seen = sign
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
