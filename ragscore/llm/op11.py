"""Operator 11: spelling variants grouped by a symmetric-delete join.

Words are counted by one partial aggregate over all texts.  Every counted word emits itself and its distinct single
deletions as keys; words that share a key meet in an equi-join, and those whose edit distance is exactly one are near.
A word's form is its near word of largest count, if that is at least twice its own; forms are followed to their roots
by joins that double the length of the step each time, so that a chain of k forms takes log2(k) joins.

A key is the 64-bit sum of its code points' random numbers, each times a power of its place, so that all deletions of a
word come from two running sums: a word of n code points sends n + 1 rows of two longs, however long it is.  Different
keys that share a number only make a candidate more; the distance that decides is of the words themselves.  Words that
share a deletion differ from it by one of the alphabet's code points at one of its places: a key's group is bounded by
word length times alphabet, not by the corpus, and no group of documents or occurrences is ever gathered.  All joins are
shuffled and sorted: a table of words that is small on disk sends some ten keys for each, which no driver need hold.

Defined cases: a null text holds no word; a null doc_id is written as nothing before the colon; repeated rows count
each time; no word gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.common import forget, met, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"
#: One run in so many, by hash, loses a code point.
EVERY = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form occurs at least so many times as often as its word.
RATIO = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def counted_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, occurs: int = LEAST_COUNT) -> DataFrame:
    """word, n: lower-cased runs of letters, of which one in EVERY by its hash has lost a code point."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("raw"))
    low = F.when(F.lower("raw") == F.col("raw"), F.col("raw")).otherwise(F.translate("raw", UPPER, LOWER))  # most runs have no capital
    runs = runs.select("id", low.alias("run")).select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurs)


def _mixed(c: np.ndarray) -> np.ndarray:
    """A random number for each code point (splitmix64)."""
    x = (c.astype(np.uint64) + np.uint64(1)) * _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def delete_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each word its own key and those of its distinct single deletions."""
    n = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
    place = np.arange(len(flat)) - first[row]
    powers = np.cumprod(np.r_[np.uint64(1), np.full(max(0, int(n.max(initial=0))), _BASE | np.uint64(1))], dtype=np.uint64)
    value = _mixed(flat)
    here = value * powers[place]
    before = np.cumsum(here, dtype=np.uint64) - here  # modulo 2**64, like all that follows
    start = before[np.minimum(first, max(0, len(flat) - 1))] if len(flat) else np.zeros(len(n), np.uint64)
    whole = np.zeros(len(n), np.uint64)
    np.add.at(whole, row, here)
    shifted = np.where(place > 0, value * powers[np.maximum(place - 1, 0)], np.uint64(0))  # code points after a deletion move down
    upto = np.cumsum(shifted, dtype=np.uint64)
    tail = np.zeros(len(n), np.uint64)
    np.add.at(tail, row, shifted)
    passed = (upto[np.minimum(first, max(0, len(flat) - 1))] if len(flat) else np.zeros(len(n), np.uint64))  # includes the first, which is 0
    deleted = (before - start[row]) + (tail[row] - (upto - passed[row]))
    new = (place == 0) | (flat != np.r_[flat[:1], flat[:-1]])  # deleting another of equal neighbours gives the same
    return np.r_[np.arange(len(n)), row[new]], np.r_[whole, deleted[new]].view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        for s in range(0, len(words), 1024):
            row, key = delete_keys(words[s : s + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[s : s + 1024][row])], ["key", "id"])


def near_words(words: DataFrame) -> DataFrame:
    """id, other: both ways, the words (id, word) at an edit distance of exactly one."""
    keys = words.select("id", "word").mapInArrow(_keys, "key long, id long")
    a, b = keys.toDF("key", "a"), keys.toDF("key", "b")
    pairs = met(a, b, "key").where("a < b").select("a", "b").distinct()
    text = words.select("id", "word")
    both = met(met(pairs, text.toDF("a", "wa"), "a"), text.toDF("b", "wb"), "b").where(F.levenshtein("wa", "wb", 1) == 1)
    return both.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("p")).select("p.*")


def variant_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, occurs: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: every counted word with the word that it is a variant of, if any."""
    counted = written(counted_words(docs, doc_id, text, least, occurs), "words")
    words = written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "numbered")
    forget(counted)
    pairs = met(near_words(words), words.select(F.col("id").alias("other"), "word", "n"), "other")
    best = pairs.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "word", "other")).alias("best"))
    chosen = -F.col("best.less") >= ratio * F.col("n")
    formed = met(words, best, "id", how="left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.struct(F.col("best.other").alias("id"), F.col("best.word").alias("word"), (-F.col("best.less")).alias("n"))).alias("form"))
    formed = written(formed, "forms")
    roots = _roots(formed.where("form is not null").select("id", F.col("form.id").alias("root")))
    text_of = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    out = met(formed, met(roots, text_of, "root").select("id", "root_word"), "id", how="left")
    return out.select("word", F.col("form.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """id, root: the end of each chain. Counts at least double along it, so there is no circle."""
    now = written(links, "roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = written(met(now, further, "root", how="left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        forget(now)
        now = after.select("id", "root")
        now._scratch_path = after._scratch_path
        if not moved:
            return now


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 4 * length(x)), lambda i: (CAST('0x' || x[(i // 8) * 2 + 1:(i // 8) * 2 + 2] AS BIGINT) >> (i % 8)) & 1)), lambda a, b: xor(a >> 1, 3988292384 * xor(a & 1, b))), 4294967295)"
OP11_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
per AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, c, {_CRC} AS h FROM (SELECT *, hex(s) AS x FROM per)),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS MATERIALIZED (SELECT word, i, word[1:i - 1] || '*' || word[i + 1:] AS hole FROM places),
pairs AS (SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT h.word, w.word FROM holes h JOIN words w ON w.word = replace(h.hole, '*', '') UNION SELECT w.word, h.word FROM holes h JOIN words w ON w.word = replace(h.hole, '*', '')),
best AS (SELECT p.word, count(*) AS n_near, first(p.other ORDER BY w.n DESC, p.other) AS other, max(w.n) AS other_n FROM pairs p JOIN words w ON w.word = p.other GROUP BY 1),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ends e ON e.word = f.word
"""
