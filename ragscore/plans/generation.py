"""From a corpus to an evaluation set: chunks, anchors, single- and multi-hop questions, variants, unanswerables, filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscore.functions.maps import known, merged
from ragscore.operators import judging, search, taskgen

#: Fixed value: the reference answer of questions that the corpus does not answer.
NEGATIVE_ANSWER = "There is not enough information in the provided corpus to answer this question."
_LABELS = ("kind", "scenario", "variant_of", "source_entity")


@dataclass(frozen=True)
class TaskConfig:
    """Task limits are the feature: so many are drawn by seed; None takes all."""

    chunk_tokens: int = 512
    overlap: int = 50
    single_hop: int | None = 200
    multi_hop: int | None = 100
    least_shared: int = 1
    least_answer: int = 3
    most_answer: int = 100
    paraphrases: int = 2
    typo_rate: float = 0.02
    unanswerable: int | None = 25
    seed: str = "tasks"
    #: So many times the limit are asked for, so that rejected replies are made up for; unanswerable ones are tried ten times.
    oversample: int = 3
    attempts: int = 10

    @classmethod
    def sized(cls, limit: int | None = None, test: bool = False) -> TaskConfig:
        """The defaults, a small test set, or ``limit`` single-hop and half as many multi-hop tasks."""
        single, multi = (limit, max(1, limit // 2)) if limit is not None else (5, 2) if test else (cls.single_hop, cls.multi_hop)
        return cls(single_hop=single, multi_hop=multi, paraphrases=1 if test else cls.paraphrases, unanswerable=2 if test else cls.unanswerable)


def generate(corpus: DataFrame, config: TaskConfig | None = None, llm: taskgen.Llm = taskgen.mock_reply, judge: taskgen.Llm | None = None, folder: str | None = None, filters: list[taskgen.SampleFilter] | None = None, entities_llm: taskgen.Llm | None = None, neighbours: DataFrame | None = None, distractors: int = 0) -> DataFrame:
    """sample_id, query, relevant_docs, reference_answer, labels, metadata from corpus (doc_id, text).

    With a folder each stage that calls a model is written there as Parquet and read again, so that no reply is asked
    for twice.  filters take the place of default_filters(judge); entities_llm lists entities; neighbours (chunk_id, pos,
    neighbour) name the chunks that unanswerable questions borrow their sentences from; with distractors the so many
    chunks that TF-IDF finds for an unanswerable question stand as its documents in the place of its source.
    """
    c = config or TaskConfig()

    def kept(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return df
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")

    def drawn(df: DataFrame, n: int | None, key: str = "sample_id") -> DataFrame:
        return df if n is None else df.orderBy(taskgen.drawn(c.seed, F.col(key)), key).limit(n)

    chunks = kept(taskgen.chunk_documents(corpus, c.chunk_tokens, c.overlap), "chunks")
    anchors = taskgen.extract_anchors(chunks)
    entities = taskgen.extract_entities(chunks) if entities_llm is None else kept(taskgen.entities_by_model(chunks, entities_llm), "entities")
    more = lambda n, times: None if n is None else n * times
    spans = taskgen.choose_answer_span(anchors).where(F.size(F.split("span", r"\s+")).between(c.least_answer, c.most_answer))
    chosen = drawn(spans.withColumn("_at", F.concat_ws(":", "chunk_id", "pos")), more(c.single_hop, c.oversample), "_at").drop("_at", "span")
    single = taskgen.single_hop_tasks(chosen, llm, c.least_answer, c.most_answer).where("trim(query) <> ''")
    single = drawn(kept(single, "single_hop"), c.single_hop).withColumn("chunks", F.array("chunk_id"))
    pairs = taskgen.graph_pairs(entities, least=c.least_shared)
    pairs = drawn(pairs.withColumn("_at", F.concat_ws(":", "a", "b")), more(c.multi_hop, c.oversample), "_at").drop("_at")
    multi = drawn(kept(taskgen.multi_hop_tasks(pairs, anchors, llm), "multi_hop"), c.multi_hop).withColumn("chunks", F.array("a", "b"))
    base = taskgen.all_tasks(single_hop=single, multi_hop=multi).select("sample_id", "kind", "query", "answer", "chunks", known(kind=F.col("kind")).alias("labels"))
    told = taskgen.paraphrases(base, c.paraphrases, llm)
    told = kept(told.withColumn("query", taskgen.with_typos(F.col("sample_id"), F.col("query"), c.typo_rate)), "paraphrases")
    told = told.join(base.select(F.col("sample_id").alias("variant_of"), "kind", "answer", "chunks", "labels"), "variant_of")
    absent = drawn(taskgen.unanswerable_candidates(entities, chunks), more(c.unanswerable, c.attempts), "chunk_id")
    absent = absent if neighbours is None else judging.with_distractor(absent, neighbours)
    absent = drawn(kept(taskgen.unanswerable_tasks(absent, chunks, llm), "unanswerable"), c.unanswerable)
    absent = absent.select("sample_id", F.lit("unanswerable").alias("kind"), F.lit("unanswerable").alias("scenario"), "source_entity", "query", F.lit(NEGATIVE_ANSWER).alias("answer"), F.array("chunk_id").alias("chunks"))
    absent = misleading(absent, chunks, distractors) if distractors else absent
    rows = base.unionByName(told, allowMissingColumns=True).unionByName(absent, allowMissingColumns=True)
    rows = _with_docs(rows, chunks).withColumn("evidence", F.transform("relevant_docs", lambda d: d["text"]))
    return as_samples(taskgen.apply_filters(rows, default_filters(llm if judge is None else judge) if filters is None else filters))


def _with_docs(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds relevant_docs: the chunks named in ``chunks``, in order."""
    named = rows.select("sample_id", F.posexplode("chunks").alias("at", "chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
    docs = named.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id", "text"))), lambda x: F.struct(x["chunk_id"].alias("doc_id"), x["text"].alias("text"))).alias("relevant_docs"))
    return rows.join(docs, "sample_id")


def misleading(asked: DataFrame, chunks: DataFrame, k: int = 2) -> DataFrame:
    """asked (sample_id, query, chunks) with the k chunks nearest to the question by TF-IDF, best first; where none is found the chunks stay."""
    found = search.tfidf_topk(asked.select("sample_id", F.col("query").alias("text")), chunks, k, query_id="sample_id", doc_id="chunk_id")
    lists = found.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))), lambda x: x["chunk_id"]).alias("_near"))
    return asked.join(lists, "sample_id", "left").withColumn("chunks", F.coalesce("_near", "chunks")).drop("_near")


def answers_occur(kinds: tuple[str, ...] = ("multi_hop", "unanswerable")) -> taskgen.SampleFilter:
    """Keeps rows whose answer occurs in a document, case ignored, and all of these kinds."""
    found = F.exists("relevant_docs", lambda d: F.contains(F.lower(d["text"]), F.lower("answer"))) & (F.col("answer") != "")
    return lambda rows: rows.where(F.col("kind").isin(*kinds) | found)


def default_filters(judge: Callable[[Column], Column]) -> list[taskgen.SampleFilter]:
    """Answers occur, questions have a fitting length, a judge says yes to multi-hop ones."""
    return [answers_occur(), taskgen.question_length, lambda rows: taskgen.consistent(rows, judge)]


def as_samples(rows: DataFrame) -> DataFrame:
    """The columns of an evaluation set; labels are those of the rows, over which goes what is known of kind, scenario, variant_of and source_entity."""
    empty = F.create_map().cast("map<string,string>")
    labels = merged(F.col("labels") if "labels" in rows.columns else empty, known(**{n: F.col(n) for n in _LABELS}))
    docs = F.transform("relevant_docs", lambda d: F.struct(d["doc_id"], d["text"], empty.alias("metadata")))
    answer = F.struct(F.col("answer").alias("text"), empty.alias("metadata"))
    return rows.select("sample_id", "query", docs.alias("relevant_docs"), answer.alias("reference_answer"), labels.alias("labels"), empty.alias("metadata"))
