"""Ranking metrics over gold (sample, doc_id) and runs (sample, pos, doc_id), all from one pass per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("recall", "precision", "hit_rate", "mrr", "map", "ndcg")


def per_sample(gold: DataFrame, runs: DataFrame, key: str, k: int | Column | None) -> DataFrame:
    """One row per sample with gold: the score of every metric at k (None: the whole list).

    k may be a column of the key, where lists are cut already.  Repeated documents of a list count once for recall and each time for the others; AP divides by all gold.
    """
    gold = gold.where("doc_id is not null and cast(doc_id as string) <> ''").select(key, "doc_id").distinct()
    sizes = gold.groupBy(key).agg(F.count("*").alias("n_gold"))
    top = runs.where(F.col("pos") <= k) if isinstance(k, int) and k else runs
    hits = top.join(gold.withColumn("hit", F.lit(1)), [key, "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    running = F.sum("hit").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("running", running)
    hit = F.col("hit") == 1
    per = hits.groupBy(key).agg(
        F.count("*").alias("n"),
        F.sum("hit").alias("n_hits"),
        F.count_distinct(F.when(hit, F.col("doc_id"))).alias("n_found"),
        F.min(F.when(hit, F.col("pos"))).alias("first"),
        F.sum(F.when(hit, F.col("running") / F.col("pos"))).alias("ap"),
        F.sum(F.when(hit, 1 / F.log2(F.col("pos") + 1))).alias("dcg"),
    )
    ideal_n = F.col("n_gold") if k is None else F.least(F.col("n_gold"), k if isinstance(k, Column) else F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), ideal_n.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(per, key, "left").select(
        key,
        zero(F.col("n_found") / F.col("n_gold")).alias("recall"),
        zero(F.col("n_hits") / F.col("n")).alias("precision"),
        zero((F.col("n_hits") > 0).cast("double")).alias("hit_rate"),
        zero(1 / F.col("first")).alias("mrr"),
        zero(F.col("ap") / F.col("n_gold")).alias("map"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def at_k(gold: DataFrame, runs: DataFrame, key: str, *ks: int, samples: DataFrame | None = None) -> DataFrame:
    """metric, value, num_samples for every ranking metric at every k, from one ranking and one aggregate.

    With samples (one row each) also num_skipped, the number of those without gold.
    """
    each = F.explode(F.array(*[F.lit(k) for k in ks]))
    place = F.struct(F.col(key), F.col("k")).alias("_place")
    many = lambda df: df.withColumn("k", each).withColumn("_place", place)
    scores = per_sample(many(gold).select("_place", "doc_id"), many(runs).where("pos <= k").select("_place", "pos", "doc_id"), "_place", F.col("_place.k"))
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS]
    rows = scores.groupBy(F.col("_place.k").alias("k")).agg(F.count("*").alias("num_samples"), *means)
    rows = gold.sparkSession.createDataFrame([(k,) for k in ks], "k int").join(rows, "k", "left").fillna(0)
    out = rows.unpivot(["k", "num_samples"], list(METRICS), "metric", "value").select(F.concat("metric", F.lit("@"), "k").alias("metric"), "value", "num_samples")
    return out if samples is None else out.join(samples.agg(F.count("*").alias("_n"))).select("metric", "value", "num_samples", (F.col("_n") - F.col("num_samples")).alias("num_skipped"))
