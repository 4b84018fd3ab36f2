"""Metrics as sufficient statistics, so that one definition serves whole sets, slices and subsets.

A metric turns samples into rows of statistics (any number of rows a sample), says which aggregates of them it needs, and
finishes with a formula over those.  The aggregates merge partially in Spark, so that a slice costs no further pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscore.functions import kernels
from ragscore.functions import text as T
from ragscore.operators import answers
from ragscore.operators.robustness import NOISE


@dataclass(frozen=True)
class Mergeable:
    """rows: samples -> key and statistics; sums: the aggregates; finish: the value; counted: the number of samples."""

    name: str
    rows: Callable[[DataFrame], DataFrame]
    sums: dict[str, Column]
    finish: Column
    counted: Column
    key: str = "sample_id"

    def aggregates(self) -> list[Column]:
        return [*[c.alias(n) for n, c in self.sums.items()], self.counted.alias("num_samples")]

    def value(self) -> Column:
        return F.round(F.coalesce(self.finish, F.lit(0.0)), 6)


def mean_of(name: str, score: Callable[[DataFrame], DataFrame], key: str = "sample_id") -> Mergeable:
    """The mean of a score per sample; samples without one are left out."""
    return Mergeable(name, score, {"total": F.sum("score"), "n": F.count("score")}, F.col("total") / F.when(F.col("n") > 0, F.col("n")), F.count("score"), key)


def bleu(order: int = 4, tokens: str = "13a", key: str = "sample_id") -> Mergeable:
    """Corpus BLEU / 100; tokens: '13a', or 'words' for white-space tokens."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        split = kernels.tokens_13a if tokens == "13a" else list
        for p, r in batches:
            yield pa.array([kernels.ngram_statistics(split(a or ""), split(b), order) for a, b in zip(p.to_pylist(), r.to_pylist(), strict=True)], pa.list_(pa.int64()))

    def rows(samples: DataFrame) -> DataFrame:
        told = samples.where("reference is not null")
        sides = [F.col("response"), F.col("reference")] if tokens == "13a" else [T.words(F.col("response")), T.words(F.col("reference"))]
        return told.select(key, F.arrow_udf(run, "array<bigint>")(*sides).alias("s"))

    sums = {f"s{i}": F.coalesce(F.sum(F.col("s")[i]), F.lit(0)) for i in range(2 + 2 * order)}
    return Mergeable(f"bleu_{order}", rows, sums, answers._bleu_value(order), F.count("*"), key)


def distinct(n: int, key: str = "sample_id") -> Mergeable:
    """The distinct share of all response n-grams; every response counts as a sample."""

    def rows(samples: DataFrame) -> DataFrame:
        grams = samples.select(key, F.posexplode_outer(T.ngrams(T.words(F.col("response")), n)).alias("at", "gram"))
        return grams.select(key, "gram", (F.coalesce("at", F.lit(0)) == 0).cast("int").alias("first"))

    return Mergeable(f"distinct_{n}", rows, {"kinds": F.count_distinct("gram"), "all_grams": F.count("gram")}, F.col("kinds") / F.when(F.col("all_grams") > 0, F.col("all_grams")), F.coalesce(F.sum("first"), F.lit(0)), key)


def evaluated(metric: Mergeable, samples: DataFrame) -> DataFrame:
    """metric, value, num_samples."""
    return metric.rows(samples).agg(*metric.aggregates()).select(F.lit(metric.name).alias("metric"), metric.value().alias("value"), "num_samples")


def sliced(metric: Mergeable, samples: DataFrame, *by: str) -> DataFrame:
    """The columns of ``by``, level, value, num_samples: by each column by itself, and in total (level names it, or 'total')."""
    rows = metric.rows(samples).join(samples.select(metric.key, *by), metric.key)
    grouped = rows.groupingSets([[c] for c in by] + [[]], *by).agg(*[F.grouping(c).alias(f"_{c}") for c in by], *metric.aggregates())
    level = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in by], F.lit("total"))
    return grouped.select(*by, level.alias("level"), metric.value().alias("value"), "num_samples")


def noise_robustness(metric: Mergeable, labelled: DataFrame, scenarios: tuple[str, ...] = NOISE) -> DataFrame:
    """The metric over noisy variants, over the metric over base samples, in one pass; 0 where the base is 0."""
    base, noisy = F.col("variant_of").isNull(), F.coalesce(F.col("scenario").isin(*scenarios), F.lit(False))
    subset = F.explode(F.filter(F.array(F.when(base, F.lit("base")), F.when(noisy, F.lit("noise"))), lambda s: s.isNotNull()))
    rows = metric.rows(labelled).join(labelled.select(metric.key, subset.alias("subset")), metric.key)
    each = rows.groupBy("subset").agg(*metric.aggregates()).select("subset", F.coalesce(metric.finish, F.lit(0.0)).alias("value"), "num_samples")
    of = lambda s, c: F.coalesce(F.max(F.when(F.col("subset") == s, F.col(c))), F.lit(0))
    both = each.agg(of("base", "value").alias("base"), of("noise", "value").alias("noisy"), of("base", "num_samples").cast("long").alias("base_samples"), of("noise", "num_samples").cast("long").alias("noise_samples"))
    value = F.when(F.col("base") > 1e-8, F.col("noisy") / F.col("base")).otherwise(F.lit(0.0))
    return both.select(F.lit(f"noise_robustness[{metric.name}]").alias("metric"), F.round(value, 6).alias("value"), F.round("base", 6).alias("base_score"), F.round("noisy", 6).alias("noise_score"), "base_samples", "noise_samples")
