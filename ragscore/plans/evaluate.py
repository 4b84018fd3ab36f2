"""Evaluation plans: metric specs, validation before anything runs, one result table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragscore.operators import answers, bertscore, judging, retrieval

ColumnFunction = Callable[[Column], Column]

TARGETS = ("RETRIEVAL_RELEVANCE", "RETRIEVAL_ACCURACY", "GENERATION_RELEVANCE", "GENERATION_FAITHFULNESS", "GENERATION_CORRECTNESS", "LATENCY", "DIVERSITY", "NOISE_ROBUSTNESS", "NEGATIVE_REJECTION", "COUNTERFACTUAL_ROBUSTNESS")


@dataclass(frozen=True)
class Metric:
    """compute takes the views of an evaluation and returns metric, value, num_samples.

    target may name one target for each metric (by its name before @) where one pass gives several.
    """

    target: str | dict[str, str]
    compute: Callable[[dict[str, DataFrame]], DataFrame]
    required: tuple[str, ...] = ()

    def targets(self) -> list[str]:
        return [self.target] if isinstance(self.target, str) else list(dict.fromkeys(self.target.values()))

    def target_column(self) -> Column:
        if isinstance(self.target, str):
            return F.lit(self.target)
        return F.create_map(*[F.lit(x) for pair in self.target.items() for x in pair])[F.substring_index("metric", "@", 1)]


@dataclass
class EvaluationPlan:
    metrics: list[Metric] = field(default_factory=list)

    def grouped_by_target(self) -> dict[str, list[Metric]]:
        return {t: [m for m in self.metrics if t in m.targets()] for t in dict.fromkeys(t for m in self.metrics for t in m.targets())}

    def validate(self, samples: DataFrame) -> None:
        """Every required column must be non-null somewhere, unless there are no samples."""
        needed = sorted({c for m in self.metrics for c in m.required})
        row = coverage(samples, needed).first().asDict()
        missing = [c for c in needed if row["num_samples"] and not row[c]]
        if missing:
            raise ValueError(f"no sample has {', '.join(missing)}")

    def run(self, views: dict[str, DataFrame]) -> DataFrame:
        """ordinal, target, metric, value, num_samples, num_errors (samples whose score failed, which the value leaves out)."""
        parts = []
        for i, m in enumerate(self.metrics):
            got = m.compute(views)
            lost = F.col("num_errors") if "num_errors" in got.columns else F.lit(0).cast("long").alias("num_errors")
            parts.append(got.select(F.lit(i).alias("ordinal"), m.target_column().alias("target"), "metric", "value", "num_samples", lost))
        return reduce(DataFrame.unionByName, parts)


def coverage(samples: DataFrame, columns: list[str]) -> DataFrame:
    """num_samples and the number of non-null values of each column, in one aggregate."""
    return samples.agg(F.count("*").alias("num_samples"), *[F.count(c).alias(c) for c in columns])


def _score(name: str, target: str, score: Callable[[DataFrame], DataFrame], required: tuple[str, ...]) -> Metric:
    return Metric(target, lambda v: answers.mean(score(v["samples"]), name), required)


#: The target of each ranking metric.
RANKING_TARGETS = {"recall": "RETRIEVAL_RELEVANCE", "precision": "RETRIEVAL_RELEVANCE", "hit_rate": "RETRIEVAL_RELEVANCE", "mrr": "RETRIEVAL_ACCURACY", "map": "RETRIEVAL_ACCURACY", "ndcg": "RETRIEVAL_ACCURACY"}


def default_plan(k: int = 5, key: str = "item_id", embed: ColumnFunction | None = None, critic: ColumnFunction | None = None, judged: bool = False, evidence: str = "retrieved", token_embed: bertscore.TokenEmbedder | None = None, judged_prefix: str = "") -> EvaluationPlan:
    """Ranking metrics (one pass), answer metrics, evidence overlap and embedding similarities, in report order.

    Views: samples (sample_id, query, response, reference), gold, runs, and answers (key, query, response) with evidence
    (key, pos, text), which is read where evidence is 'retrieved', or relevant likewise, where it is 'relevant'. embed adds similarities of whole texts, token_embed
    precision, recall and F of aligned tokens; judged adds a critic's scores, named after
    judged_prefix, and then needs one.
    """
    if judged and critic is None:
        raise ValueError("a judged plan needs a critic")
    if evidence not in ("retrieved", "relevant"):
        raise ValueError(f"unknown evidence {evidence}")
    shown = (lambda v: v["evidence"].where(F.col("pos") <= k)) if evidence == "retrieved" else (lambda v: v["relevant"])
    s = ("response", "reference")
    right, apt, true = "GENERATION_CORRECTNESS", "GENERATION_RELEVANCE", "GENERATION_FAITHFULNESS"
    metrics = [
        Metric(RANKING_TARGETS, lambda v: retrieval.at_k(v["gold"], v["runs"], key, k)),
        _score("exact_match", right, answers.exact_match, s),
        _score("token_f1", right, answers.token_f1, s),
        _score("rouge1_answer", right, lambda d: answers.rouge(d, "1"), s),
        _score("rouge2_answer", right, lambda d: answers.rouge(d, "2"), s),
        _score("rougeL_answer", right, lambda d: answers.rouge(d, "L"), s),
        Metric(right, answers_bleu, s),
        Metric(true, lambda v: answers.mean(answers.evidence_overlap(v["answers"], shown(v), key, 1), "evidence_overlap_n1")),
        _score("embedding_similarity_reference", right, lambda d: answers.hashed_similarity(d.where("reference <> ''"), "sample_id", F.col("response"), F.col("reference")), s),
        _score("embedding_similarity_query", apt, lambda d: answers.hashed_similarity(d.where("query <> ''"), "sample_id", F.col("response"), F.col("query")), ("query",)),
    ]
    if embed is not None:
        for other, target in (("reference", right), ("query", apt)):
            metrics.append(_score(f"openai_bertscore_f1_{other}", target, lambda d, o=other: answers.embedded_similarity(d.where(f"{o} <> ''"), "sample_id", F.col("response"), F.col(o), embed), ("response", other)))
    if token_embed is not None:
        for other, target in (("reference", right), ("query", apt)):
            metrics.append(Metric(target, lambda v, o=other: bertscore.mean_scores(v["samples"], o, token_embed), ("response", other)))
    if judged:
        metrics.append(Metric(true, lambda v: answers.mean(judging.faithfulness(v["answers"], evidence_of(shown(v), key), critic, key), f"{judged_prefix}llm_faithfulness", errors=True)))
        metrics.append(Metric(apt, lambda v: answers.mean(judging.answer_quality(v["samples"], critic), f"{judged_prefix}llm_answer_quality", errors=True), ("query",)))
    return EvaluationPlan(metrics)


def evidence_of(ranked: DataFrame, key: str) -> DataFrame:
    """key, evidence: the texts of each list, in order."""
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("evidence"))


def answers_bleu(views: dict[str, DataFrame]) -> DataFrame:
    return answers.bleu(views["samples"])


def evaluate(system: Callable[[DataFrame, int], DataFrame], samples: DataFrame, plan: EvaluationPlan, top_k: int, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Validates first, runs the system once (a DataFrame function), then all metrics over its kept outputs."""
    plan.validate(samples)
    outputs = system(samples, top_k).persist()
    try:
        results = plan.run({"samples": outputs, **(views or {})}).collect()  # a row per metric
    finally:
        outputs.unpersist()
    return samples.sparkSession.createDataFrame(results, "ordinal int, target string, metric string, value double, num_samples long, num_errors long")


def views_of(samples: DataFrame, outputs: DataFrame, key: str = "sample_id") -> dict[str, DataFrame]:
    """The views of a plan from an evaluation set and outputs (key, response, retrieved: array of doc_id and text)."""
    both = samples.join(outputs, key)
    rows = both.select(key, "query", "response", F.col("reference_answer.text").alias("reference"))
    ranked = both.select(key, F.posexplode("retrieved").alias("pos", "d")).select(key, (F.col("pos") + 1).alias("pos"), "d.doc_id", "d.text")
    relevant = samples.select(key, F.posexplode("relevant_docs").alias("pos", "d")).select(key, (F.col("pos") + 1).alias("pos"), "d.doc_id", "d.text")
    gold = relevant.select(key, "doc_id")
    return {"relevant": relevant, "samples": rows, "answers": rows, "gold": gold, "runs": ranked, "evidence": ranked}


def labelled_columns(samples: DataFrame) -> DataFrame:
    """What a plan may require of an evaluation set before any system runs; responses come later and count as there."""
    return samples.select("sample_id", "query", F.col("reference_answer.text").alias("reference"), F.lit("").alias("response"))
