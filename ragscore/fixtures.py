"""Evaluation inputs derived from the driver's tables: gold passages, ranked runs, question-answer pairs, variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragscore.functions.text import term_set, words
from ragscore.operators.blocks import sparse_top_k
from ragscore.operators.taskgen import find_relevant

RUN_DEPTH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passage_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, doc_id where the document contains the passage.

    A word inside the passage stands as a word in the text too, so documents and passages first meet on the passage's
    longest inner word; only the pairs that meet are compared.
    """
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text")
    inner = F.slice(words(F.col("text")), 2, F.greatest(F.lit(0), F.size(words(F.col("text"))) - 2))
    keyed = items.where("text is not null").select("item_id", F.col("text").alias("passage"), F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    met = docs.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(keyed.where("word is not null"), "word").select("doc_id", "item_id", "passage")
    found = met.join(docs, "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
    rest = keyed.where("word is null").select("item_id", F.col("passage").alias("span"))  # of one or two words
    if rest.isEmpty():  # spares the index of the documents' words
        return found
    far = find_relevant(rest.select("span"), docs.withColumnRenamed("doc_id", "chunk_id")).join(rest, "span")
    return found.unionByName(far.select("item_id", F.col("chunk_id").alias("doc_id")))


def _share(shared: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Shared terms per thousand of the union, rounded down."""
    return np.floor(1000 * shared / (q[None, :] + d[:, None] - shared))


def passage_run(spark: SparkSession, sf_dir: str, depth: int = RUN_DEPTH) -> DataFrame:
    """item_id, pos, doc_id, score: documents ranked by shared terms per thousand of the union."""

    def sets(name: str, id_col: str) -> DataFrame:
        found = term_set(F.coalesce("text", F.lit("")))
        return table(spark, sf_dir, name).select(F.col(id_col).alias("id"), found.alias("terms")).select("id", "terms", F.array_repeat(F.lit(1.0), F.size("terms")).alias("weights"), F.size("terms").cast("double").alias("size"))

    sizes = [table(spark, sf_dir, name).count() for name in ("benchmark", "documents")]
    ranked = sparse_top_k(sets("benchmark", "item_id"), sets("documents", "doc_id"), depth, _share, ("item_id", "doc_id"), *sizes)
    ranked = ranked.withColumn("score", F.col("score").cast("long"))
    pos = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return ranked.withColumn("pos", pos).where(F.col("pos") <= depth).select("item_id", "pos", "doc_id", "score")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, conv_id, turn, query, response, reference from the turns of conversations."""
    turns = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    ahead = lambda c, n: F.lead(c, n).over(order)
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("query"), ahead("role", 1).alias("r1"), ahead("text", 1).alias("response"), ahead("role", 3).alias("r3"), ahead("text", 3).alias("t3"))
    rows = rows.where("role = 'user' and r1 = 'assistant'")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"), "conv_id", "turn", "query", "response", F.when(F.col("r3") == "assistant", F.col("t3")).alias("reference"))


def qa_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa with variant_of and scenario: the first row of a conversation is the base of the later ones."""
    rows = qa(spark, sf_dir)
    order = Window.partitionBy("conv_id").orderBy("turn")
    base = F.first("sample_id").over(order)
    rows = rows.withColumn("base", base)
    later = F.col("sample_id") != F.col("base")
    kind = F.element_at(F.array(F.lit("paraphrase"), F.lit("typo"), F.lit("counterfactual")), (F.col("conv_id") % 3 + 1).cast("int"))
    scenario = F.when(later, kind).when(F.col("conv_id") % 5 == 0, F.lit("unanswerable"))
    return rows.select("*", F.when(later, F.col("base")).alias("variant_of"), scenario.alias("scenario")).drop("base")
