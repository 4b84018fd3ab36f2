"""Column helpers for text: tokens, normalisation, n-grams, multiset overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTICLES = ("a", "an", "the")
_WORD = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    """White-space tokens; none for blank or null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), F.lit(""))


def number_of_words(text: Column, least: int, most: int) -> Column:
    """Whether a text has least to most white-space tokens, by one pattern that makes no array of them."""
    some = rf"\S++(?:\s++\S++){{{max(least, 1) - 1},{most - 1}}}+\s*+"
    return F.coalesce(text, F.lit("")).rlike(rf"(?U)^\s*+{some if least > 0 else f'(?:{some})?+'}\z") if most >= max(least, 1) else F.size(words(text)).between(least, most)


def term_set(text: Column) -> Column:
    """Distinct lower-cased runs of letters, digits and underscores of two characters or more."""
    return F.array_distinct(terms(text))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def normalised_tokens(text: Column, ignore_case: bool = True, ignore_punctuation: bool = True, ignore_articles: bool = True) -> Column:
    text = F.lower(text) if ignore_case else text
    if ignore_punctuation:
        text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " ")
    if ignore_articles and not ignore_punctuation:
        text = F.regexp_replace(text, r"(?i)(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    tokens = words(text)
    return F.filter(tokens, lambda w: ~F.lower(w).isin(*ARTICLES)) if ignore_articles and ignore_punctuation else tokens


def rouge_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams, joined by a blank; none if there are fewer tokens."""
    if n == 1:
        return tokens

    def grams(t: Column) -> Column:
        at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(t, i, n), " "))

    return F.get(F.transform(F.array(tokens), grams), F.lit(0))  # bound as a variable, so that tokens are computed once and not for each place


def shared_counts(df: DataFrame, key: str, left: Column, right: Column) -> DataFrame:
    """key, shared: size of the multiset intersection of two token arrays, by partial aggregation alone."""
    side = lambda tokens, a: F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(a).alias("a"), F.lit(1 - a).alias("b")))
    rows = df.select(key, F.explode(F.concat(side(left, 1), side(right, 0))).alias("x")).select(key, "x.*")
    counts = rows.groupBy(key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"))


def f_measure(shared: Column, predicted: Column, target: Column) -> Column:
    """Harmonic mean of shared/predicted and shared/target, 0 where nothing is shared."""
    return F.when(shared > 0, 2.0 * shared / (predicted + target)).otherwise(F.lit(0.0))
