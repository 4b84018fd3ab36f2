"""Answer metrics: exact match, token F1, ROUGE, BLEU, evidence overlap, hashed-embedding similarity, distinct n-grams.

Inputs have one row per sample under ``key``; samples without a reference are skipped, as each metric says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscore.functions import kernels
from ragscore.functions import text as T


def mean(scores: DataFrame, metric: str, samples: DataFrame | None = None, errors: bool = False) -> DataFrame:
    """metric, value, num_samples over rows with a score; with samples (one row each) also num_skipped, those without one.

    With errors also num_errors, the rows whose score is null, as where a model gave no reply.
    """
    if samples is not None:
        return mean(scores, metric).join(samples.agg(F.count("*").alias("_n"))).select("metric", "value", "num_samples", (F.col("_n") - F.col("num_samples")).alias("num_skipped"))
    lost = [(F.count("*") - F.count("score")).alias("num_errors")] if errors else []
    return scores.agg(F.lit(metric).alias("metric"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("value"), F.count("score").alias("num_samples"), *lost)


def _with_reference(samples: DataFrame, target: str = "reference") -> DataFrame:
    return samples.where(F.col(target).isNotNull() & (F.col(target) != ""))


def exact_match(samples: DataFrame, key: str = "sample_id", **flags: bool) -> DataFrame:
    rows = _with_reference(samples)
    same = F.array_join(T.normalised_tokens(F.col("response"), **flags), " ") == F.array_join(T.normalised_tokens(F.col("reference"), **flags), " ")
    return rows.select(key, F.coalesce(same, F.lit(False)).cast("double").alias("score"))


def _overlap(rows: DataFrame, key: str, left: Column, right: Column, like: tuple[Column, Column] | None = None) -> DataFrame:
    """key, n_l, n_r, shared. like: arrays of the same sizes as left and right that cost less, to be counted in their place."""
    sized = rows.select(key, left.alias("l"), right.alias("r"))
    counted = rows.select(key, like[0].alias("l"), like[1].alias("r")) if like else sized
    return counted.select(key, F.size("l").alias("n_l"), F.size("r").alias("n_r")).join(T.shared_counts(sized, key, F.col("l"), F.col("r")), key, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def token_f1(samples: DataFrame, key: str = "sample_id", **flags: bool) -> DataFrame:
    rows = _with_reference(samples)
    c = _overlap(rows, key, T.normalised_tokens(F.coalesce("response", F.lit("")), **flags), T.normalised_tokens(F.col("reference"), **flags))
    both_empty = (F.col("n_l") == 0) & (F.col("n_r") == 0)
    return c.select(key, F.when(both_empty, 1.0).otherwise(T.f_measure(F.col("shared"), F.col("n_l"), F.col("n_r"))).alias("score"))


def _stems(left: Column, right: Column) -> Column:
    """p and t: both arrays of tokens as stems, by one worker; each distinct token of a batch is stemmed once."""
    kind = pa.struct([("p", pa.list_(pa.string())), ("t", pa.list_(pa.string()))])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for both in batches:
            ends, codes, known = kernels.token_codes(*both)
            stems = pa.array(kernels.rouge_stems(known.to_pylist()), pa.string())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(e, pa.int32()), stems.take(pa.array(x))) for e, x in zip(ends, codes, strict=True)], fields=list(kind))

    return F.arrow_udf(run, "struct<p:array<string>,t:array<string>>")(left, right)


def _lcs(left: Column, right: Column, stemmed: bool) -> Column:
    """Length of the longest common subsequence of two arrays of tokens, or of their stems, compared by number."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            (ends_a, ends_b), (x, y), known = kernels.token_codes(a, b)
            if stemmed:
                of = pa.array(kernels.rouge_stems(known.to_pylist()), pa.string()).dictionary_encode().indices.to_numpy()
                x, y = of[x], of[y]
            yield pa.array([kernels.lcs_length(x[ends_a[i] : ends_a[i + 1]], y[ends_b[i] : ends_b[i + 1]]) for i in range(len(a))], pa.int32())

    return F.arrow_udf(run, "int")(left, right)


def rouge(samples: DataFrame, kind: str, compare_to: str = "reference", use_stemmer: bool = True, key: str = "sample_id", skip_blank: bool = True) -> DataFrame:
    """kind: '1', '2' or 'L'. skip_blank=False keeps an empty reference, as the legacy answer metric does."""
    rows = _with_reference(samples, compare_to) if skip_blank else samples.where(F.col(compare_to).isNotNull())
    rows = rows.select(key, T.rouge_tokens(F.coalesce("response", F.lit(""))).alias("p"), T.rouge_tokens(F.col(compare_to)).alias("t"))
    if kind == "L":
        return rows.select(key, T.f_measure(_lcs(F.col("p"), F.col("t"), use_stemmer), F.size("p"), F.size("t")).alias("score"))
    n = int(kind)
    plain = T.ngrams(F.col("p"), n), T.ngrams(F.col("t"), n)
    if not use_stemmer:
        c = _overlap(rows, key, *plain)
    else:  # a text has as many stems as tokens
        stems = rows.select("*", _stems(F.col("p"), F.col("t")).alias("s")).select(key, "p", "t", "s.p", "s.t").toDF(key, "p", "t", "sp", "st")
        c = _overlap(stems, key, T.ngrams(F.col("sp"), n), T.ngrams(F.col("st"), n), plain)
    return c.select(key, T.f_measure(F.col("shared"), F.col("n_l"), F.col("n_r")).alias("score"))


def rouge_l_legacy(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """ROUGE-L of the older answer metric: stems, and an empty reference scores 0 rather than being skipped."""
    return rouge(samples, "L", skip_blank=False, key=key)


def bleu(samples: DataFrame, order: int = 4, key: str = "sample_id") -> DataFrame:
    """Corpus BLEU / 100 with exponential smoothing and effective order; only a null reference is skipped."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for p, r in batches:
            yield pa.array([kernels.bleu_statistics(a or "", b, order) for a, b in zip(p.to_pylist(), r.to_pylist(), strict=True)], pa.list_(pa.int64()))

    rows = samples.where("reference is not null").select(F.arrow_udf(run, "array<bigint>")("response", "reference").alias("s"))
    sums = rows.agg(F.count("*").alias("num_samples"), *[F.coalesce(F.sum(F.col("s")[i]), F.lit(0)).alias(f"s{i}") for i in range(2 + 2 * order)])
    return sums.select(F.lit(f"bleu_{order}").alias("metric"), F.round(_bleu_value(order), 6).alias("value"), "num_samples")


def _bleu_value(order: int) -> Column:
    """The closing formula over the summed statistics, as one expression."""
    logs, halvings, used, alive = F.lit(0.0), F.lit(1.0), F.lit(0), F.lit(True)
    for n in range(order):
        match, total = F.col(f"s{2 + 2 * n}").cast("double"), F.col(f"s{3 + 2 * n}").cast("double")
        alive = alive & (total > 0)
        halvings = F.when(alive & (match == 0), halvings * 2).otherwise(halvings)
        share = F.when(match == 0, 1 / (halvings * F.greatest(total, F.lit(1.0)))).otherwise(match / F.greatest(total, F.lit(1.0)))
        logs = F.when(alive, logs + F.ln(share)).otherwise(logs)
        used = F.when(alive, used + 1).otherwise(used)
    any_match = sum((F.col(f"s{2 + 2 * n}") for n in range(1, order)), F.col("s2")) > 0
    brevity = F.when(F.col("s0") >= F.col("s1"), 1.0).otherwise(F.exp(1 - F.col("s1") / F.greatest(F.col("s0"), F.lit(1))))
    return F.when(any_match & (used > 0), brevity * F.exp(logs / F.greatest(used, F.lit(1)))).otherwise(F.lit(0.0))


def whitespace_bleu_statistics(samples: DataFrame, order: int = 4, key: str = "sample_id") -> DataFrame:
    """n, matches, total of white-space n-grams, summed over the corpus."""
    rows = samples.where("reference is not null").select(key, T.words(F.col("response")).alias("p"), T.words(F.col("reference")).alias("r"))
    parts = []
    for n in range(1, order + 1):
        c = _overlap(rows, key, T.ngrams(F.col("p"), n), T.ngrams(F.col("r"), n))
        parts.append(c.agg(F.lit(n).alias("n"), F.sum("shared").alias("matches"), F.sum("n_l").cast("long").alias("total")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evidence_overlap(predictions: DataFrame, evidence: DataFrame, key: str, n: int = 1) -> DataFrame:
    """predictions (key, response), evidence (key, pos, text): share of response n-grams that the joined evidence covers."""
    joined = evidence.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("evidence"))
    rows = predictions.join(joined, key)
    c = _overlap(rows, key, T.ngrams(T.words(F.col("response")), n), T.ngrams(T.words(F.col("evidence")), n))
    return c.select(key, F.when(F.col("n_l") > 0, F.col("shared") / F.col("n_l")).otherwise(F.lit(0.0)).alias("score"))


def _murmur_bucket(buckets: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([abs(kernels.murmur3(t)) % buckets for t in batch.to_pylist()], pa.int32())

    return F.arrow_udf(run, "int")


def hashed_similarity(pairs: DataFrame, key: str, left: Column, right: Column, bucket: str = "murmur3", buckets: int = 4096) -> DataFrame:
    """Cosine of hashed bags of words of two text columns; 0 if either is empty. bucket: 'murmur3' or 'md5' (portable to SQL)."""
    side = lambda c, a: F.transform(T.terms(F.coalesce(c, F.lit(""))), lambda t: F.struct(t.alias("t"), F.lit(a).alias("a"), F.lit(1 - a).alias("b")))
    rows = pairs.select(key, F.explode(F.concat(side(left, 1), side(right, 0))).alias("x")).select(key, "x.*")
    rows = rows.groupBy(key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    place = _murmur_bucket(buckets)(F.col("t")) if bucket == "murmur3" else F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % buckets
    vectors = rows.groupBy(key, place.alias("bucket")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    dots = vectors.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    score = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa").cast("double") * F.col("bb")))
    return pairs.select(key).join(dots, key, "left").select(key, F.coalesce(score, F.lit(0.0)).alias("score"))


def embedded_similarity(pairs: DataFrame, key: str, left: Column, right: Column, embed: Callable[[Column], Column]) -> DataFrame:
    """Cosine of the embeddings of two whole texts; 0 where either has no length or no vector. embed: text -> array of numbers."""
    rows = pairs.select(key, embed(F.coalesce(left, F.lit(""))).cast("array<double>").alias("a"), embed(F.coalesce(right, F.lit(""))).cast("array<double>").alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    norms = F.sqrt(dot("a", "a") * dot("b", "b"))
    return rows.select(key, F.coalesce(F.when(norms > 0, dot("a", "b") / norms), F.lit(0.0)).alias("score"))


def distinct_n(samples: DataFrame, n: int) -> DataFrame:
    """Distinct share of all response n-grams, pooled; num_samples counts all responses."""
    grams = samples.select(F.explode(T.ngrams(T.words(F.col("response")), n)).alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    value = grams.agg(F.coalesce(F.round(F.count("*") / F.sum("c"), 6), F.lit(0.0)).alias("value"))
    return samples.agg(F.count("*").alias("num_samples")).join(value).select(F.lit(f"distinct_{n}").alias("metric"), "value", "num_samples")


