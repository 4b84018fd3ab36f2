"""Robustness, rejection, latency and diversity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragscore.functions.skew import joined_by_key
from ragscore.operators.answers import hashed_similarity

NOISE = ("paraphrase", "typo")
#: Phrases of a refusal.
REFUSALS = ("i don't know", "cannot answer", "not enough information")


def noise_robustness(labelled: DataFrame, scores: DataFrame, name: str, key: str = "sample_id", scenarios: tuple[str, ...] = NOISE) -> DataFrame:
    """Mean score of noisy variants over the mean of base samples, from one conditional aggregate; 0 where the base is 0."""
    rows = labelled.select(key, "variant_of", "scenario").join(scores, key)
    base, noisy = F.col("variant_of").isNull(), F.col("scenario").isin(*scenarios)
    got = rows.agg(F.coalesce(F.avg(F.when(base, F.col("score"))), F.lit(0.0)).alias("base"), F.coalesce(F.avg(F.when(noisy, F.col("score"))), F.lit(0.0)).alias("noisy"), F.count_if(base).alias("base_samples"), F.count_if(noisy).alias("noise_samples"))
    value = F.when(F.col("base") > 1e-8, F.col("noisy") / F.col("base")).otherwise(F.lit(0.0))
    return got.select(F.lit(f"noise_robustness[{name}]").alias("metric"), F.round(value, 6).alias("value"), F.round("base", 6).alias("base_score"), F.round("noisy", 6).alias("noise_score"), "base_samples", "noise_samples")


def negative_rejection_rate(labelled: DataFrame, patterns: Sequence[str] = REFUSALS) -> DataFrame:
    refused: Column = F.lit(False)
    for p in patterns:
        refused = refused | F.contains(F.lower("response"), F.lit(p.lower()))
    rows = labelled.where("scenario = 'unanswerable'")
    return rows.agg(F.lit("negative_rejection_rate").alias("metric"), F.round(F.coalesce(F.avg(refused.cast("double")), F.lit(0.0)), 6).alias("value"), F.count("*").alias("num_samples"))


PairScore = Callable[[DataFrame, str, Column, Column], DataFrame]


def counterfactual_consistency(labelled: DataFrame, bucket: str = "murmur3", scenario: str = "counterfactual", key: str = "sample_id", score: PairScore | None = None) -> DataFrame:
    """Mean similarity of a variant's response to its base's; of repeated base ids the last counts, dangling variants drop.

    score compares pairs of texts, (pairs, key, left, right) -> key, score; without one it is the cosine of hashed words.
    """
    base = labelled.groupBy(F.col(key).alias("variant_of")).agg(F.max_by("response", "turn").alias("base_response"))
    pairs = labelled.where((F.col("scenario") == scenario) & F.col("variant_of").isNotNull()).select(key, "variant_of", "response").join(base, "variant_of")
    compare = score or (lambda p, k, a, b: hashed_similarity(p, k, a, b, bucket))
    scores = compare(pairs, key, F.col("base_response"), F.col("response"))
    return scores.agg(F.lit("counterfactual_consistency").alias("metric"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("value"), F.count("*").alias("num_samples"))


#: Ranks of a sketch are off by one in so many at most.
ACCURACY = 10_000


def exact_quantile(rows: DataFrame, quantile: float, key: str = "key", value: str = "value") -> DataFrame:
    """key, value, n: the smallest value that at least the share ``quantile`` of a key's values do not exceed.

    A sketch of bounded size encloses it between two values; values below are only counted, and of those between, about
    four in ACCURACY, each distinct one is counted. No buffer grows with a key's values, and no key gathers them in a task.
    """
    there = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"))
    around = [min(1.0, max(0.0, quantile + d * 2 / ACCURACY)) for d in (-1, 1)]
    bounds = there.groupBy("key").agg(F.count("*").alias("n"), F.percentile_approx("value", around, ACCURACY).alias("at"))
    bounds = bounds.select("key", "n", F.col("at")[0].alias("low"), F.col("at")[1].alias("high"))
    near = joined_by_key(there, bounds, "key", "n").where("value <= high")
    counted = near.groupBy("key", "n", F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).agg(F.count("*").alias("c"))  # null: all below
    upto = F.sum("c").over(Window.partitionBy("key").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.greatest(F.lit(1.0), F.ceil(F.lit(quantile) * F.col("n")))
    return counted.withColumn("upto", upto).where((F.col("upto") >= rank) & F.col("value").isNotNull()).groupBy("key").agg(F.min("value").alias("value"), F.max("n").alias("n"))


def latency(timings: DataFrame, quantile: float | None = None) -> DataFrame:
    """timings (key, value): mean, or discrete quantile, for each key."""
    if quantile is None:
        got, name = timings.where("value is not null").groupBy("key").agg(F.avg("value").alias("value"), F.count("*").alias("n")), "mean_latency"
    else:
        got, name = exact_quantile(timings, quantile), f"latency_q{quantile}"
    return got.select(F.concat(F.lit(f"{name}["), "key", F.lit("]")).alias("metric"), F.round("value", 6).alias("value"), F.col("n").alias("num_samples"))


def intra_list_diversity(lists: DataFrame, k: int, key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """1 - mean pairwise cosine of the first k vectors of each list, from sums of unit vectors: no pairs are built."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lists.where((F.col("pos") <= k) & F.col(vector).isNotNull()).select(key, F.posexplode(F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))).alias("d", "x"), (norm > 0).cast("int").alias("nonzero"))
    sums = unit.groupBy(key, "d").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.sum("nonzero").alias("m"))
    per = sums.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"), F.max("m").alias("m")).where("n > 1")
    return per.select(key, (1 - (F.col("q") - F.col("m")) / (F.col("n") * (F.col("n") - 1))).alias("score"))


def sliced(scores: DataFrame, slice_col: str) -> DataFrame:
    """Mean score by slice and in total, by grouping sets."""
    return scores.rollup(slice_col).agg(F.grouping(slice_col).alias("is_total"), F.round(F.avg("score"), 6).alias("value"), F.count("score").alias("num_samples"))


