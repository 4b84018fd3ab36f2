"""From raw documents to packed training sequences, in five stages; each is written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  Every
stage reads all that its predecessor kept.  Rows that share a doc_id share the fate of that id where documents are
dropped as near-duplicates.

Defined cases: texts that are null or have no letter go with the language stage, as do rows whose class is less likely
than LEAST_LANGUAGE_SCORE; further columns go along unchanged whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm import op1, op3, op9, op10
from ragscore.llm.common import forget, order_id, release, scope, tidy, written
from ragscore.llm.near_documents import near_documents

#: A language whose probability is lower is no answer.
LEAST_LANGUAGE_SCORE = 0.3


def _all(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the operator's cut go."""
    model = op1.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told = _free(docs, "toxicity")
    return op1.toxicity(docs, model, into=told).where(F.col(told)["score"] < op1.CUT).select(*_all(docs))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: without a letter, or without a class that stands out."""
    told = _free(docs, "language")
    scored = op10.language_id(docs, op10.train(docs), into=told)
    return scored.where((F.col(told)["lang_pred"] != op10.UNKNOWN) & (F.col(told)["score"] >= LEAST_LANGUAGE_SCORE)).select(*_all(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest id."""
    gone = near_documents(docs).where(~F.col("kept")).select(order_id("doc_id").alias("_gone")).distinct()
    return docs.join(gone, order_id("doc_id") == F.col("_gone"), "left_anti")


def _whole_letters(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if x is None else x.decode("utf-8", "ignore") for x in batch.to_pylist()], pa.string())


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that start earlier elsewhere go from the texts; a letter cut in two goes with its bytes."""
    rest = F.struct(*[F.col(c) for c in _all(docs) if c not in ("`text`", "`n_chars`")])
    cut = op9.suffix_array_dedup(docs.select("doc_id", "text", rest.alias("_rest")), carry=["_rest"])
    text = F.try_validate_utf8(F.col("kept").cast("string"))
    text = F.coalesce(text, F.arrow_udf(_whole_letters, "string")(F.when(text.isNull(), F.col("kept"))))
    cut = cut.withColumn("text", text)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return cut.select(*[own[c].alias(c) if c in own else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return op3.best_fit_pack(docs)


_ORDER = [("toxicity", drop_toxic), ("language_id", keep_languages), ("simhash_near_dedup", drop_near_copies), ("suffix_array_dedup", cut_repeats), ("best_fit_packing", pack)]


def _staged(at: int) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage; its input being a table, what the stage before it left in the scratch folder and in memory goes first."""
    name, stage = _ORDER[at]

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if at:
            release(spark, f"{_ORDER[at - 1][0]} {sf_dir}")
        tidy(spark)
        with scope(f"{name} {sf_dir}"):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _staged(at)) for at, (name, _) in enumerate(_ORDER)]

#: The stages learn models and hash shingles, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            forget(last)
        last = docs
    return docs
