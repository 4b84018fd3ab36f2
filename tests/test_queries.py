"""Every query with an oracle against DuckDB; hand-computed cases for the rest."""

from __future__ import annotations

import json
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from ragscore import catalog, oracle
from ragscore.functions import adapters, kernels
from ragscore.operators import answers, judging, retrieval, robustness, search, taskgen
from ragscore.plans import commands, systems
from ragscore.plans.evaluate import EvaluationPlan, Metric, default_plan
from ragscore.plans.generation import TaskConfig, generate
from ragscore.sources import io
from ragscore.sources.settings import Settings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(df):
    def one(v):
        if v is None or v != v:
            return None
        return str(v) if hasattr(v, "year") else float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    return sorted(repr([one(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracle.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_ranking_edge_cases(spark):
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, ""), (2, "x"), (3, None), (4, "q")], "s int, doc_id string")
    runs = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "z"), (2, 1, "y"), (3, 1, "a")], "s int, pos int, doc_id string")
    got = {r.s: r for r in retrieval.per_sample(gold, runs, "s", 5).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].recall == 0.5 and got[1].precision == pytest.approx(2 / 3) and got[1].map == 1.0 and got[1].mrr == 1.0
    assert got[1].ndcg == pytest.approx((1 + 1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert got[2].recall == got[4].precision == 0.0


def test_answer_edge_cases(spark):
    rows = spark.createDataFrame([(1, "The Cat!", "cat"), (2, "...", "the"), (3, "x", None), (4, "x", ""), (5, "a b b", "b b c")], "sample_id int, response string, reference string")
    assert {r.sample_id: r.score for r in answers.exact_match(rows).collect()} == {1: 1.0, 2: 1.0, 5: 0.0}
    f1 = {r.sample_id: r.score for r in answers.token_f1(rows).collect()}
    assert f1[1] == f1[2] == 1.0 and f1[5] == pytest.approx(0.8)
    assert {r.sample_id: r.score for r in answers.rouge(rows, "L").collect()}[5] == pytest.approx(2 / 3)
    assert answers.bleu(rows.where("sample_id = 1").withColumn("response", F.col("reference"))).first().num_samples == 1


def test_kernels():
    stems = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "adjustable": "adjust", "generalizations": "gener", "controlling": "control"}
    assert {w: kernels.porter_stem(w) for w in stems} == stems
    assert kernels.lcs_length("a b c d".split(), "b x d".split()) == 2 and kernels.lcs_length([], ["a"]) == 0
    assert kernels.murmur3("") == 0 and kernels.murmur3("hello") == 613153351
    assert kernels.tokens_13a("Hello, world. 3.5") == ["Hello", ",", "world", ".", "3.5"]


def test_perfect_bleu(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "sample_id int, response string, reference string")
    assert answers.bleu(rows).first().value == pytest.approx(1.0)


def test_generation_edge_cases(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "w"), (4, " ".join("abcdef"))], "doc_id int, text string")
    got = [(r.parent_doc_id, r.text) for r in taskgen.chunk_documents(docs, 4, 2).orderBy("chunk_id").collect()]
    assert got == [(3, "w"), (4, "a b c d"), (4, "c d e f"), (4, "e f")]
    chunks = spark.createDataFrame([("a", "party time"), ("b", "art")], "chunk_id string, text string")
    spans = spark.createDataFrame([("art",), ("y t",), (None,), ("zzz",)], "span string")
    assert {(r.span, r.chunk_id) for r in taskgen.find_relevant(spans, chunks).collect()} == {("art", "a"), ("art", "b"), ("y t", "a")}
    q, a = taskgen.parse_multi_hop(F.lit("Question: one\n two\nANSWER: three"))
    assert spark.range(1).select(q, a).first() == ("one two", "three")
    assert taskgen.mutate_entity("1999", "s").isdigit() and taskgen.mutate_entity("abc", "s") is None


def test_plan_validation(spark):
    plan = EvaluationPlan([Metric("LATENCY", lambda v: v["samples"], ("reference",))])
    rows = spark.createDataFrame([(1, None)], "sample_id int, reference string")
    with pytest.raises(ValueError, match="reference"):
        plan.validate(rows)
    plan.validate(rows.where("false"))


def test_jsonl_round_trip(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"sample_id": "1", "query": "é?", "relevant_docs": [], "extra": 1}\n\n{"sample_id": "2", "query": "q", "relevant_docs": [{"doc_id": "d", "text": "t"}], "labels": {"hops": 2}}\n')
    rows = io.load_jsonl(spark, str(tmp_path / "in.jsonl")).orderBy("sample_id").collect()
    assert rows[0].relevant_docs is None and rows[0].labels == {} and rows[1].labels == {"hops": "2"}
    io.save_jsonl(io.load_jsonl(spark, str(tmp_path / "in.jsonl")), str(tmp_path / "out"))
    assert io.load_jsonl(spark, str(tmp_path / "out")).count() == 2


def test_lists_and_latency(spark):
    lists = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 1, [1.0, 0.0]), (3, 1, [0.0, 0.0]), (3, 2, [1.0, 0.0])], "query_id int, pos int, embedding array<double>")
    assert {r.query_id: r.score for r in robustness.intra_list_diversity(lists, 5).collect()} == {1: 1.0, 3: 1.0}
    corpus = spark.createDataFrame([(1, 5, "x"), (2, 5, "y"), (3, 6, "z")], "ordinal int, doc_id int, text string")
    assert [(r.doc_id, r.ordinal, r.text) for r in search.closed_world_corpus(corpus).orderBy("ordinal").collect()] == [(5, 1, "y"), (6, 3, "z")]


def test_judging(spark):
    replies = {"-0.5": 0.5, "8/10": 1.0, "about .25.": 0.25, "none": 0.0, "": 0.0, None: 0.0}
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    assert [r[0] for r in rows.orderBy("i").select(judging.critic_score(F.col("r"))).collect()] == list(replies.values())
    docs = spark.createDataFrame([(1, [" a. b ", None]), (2, []), (3, None)], "k int, evidence array<string>")
    got = docs.orderBy("k").select(judging.first_sentence(F.col("evidence")), judging.numbered_docs(F.col("evidence"))).collect()
    assert [r[0] for r in got] == [" a.", judging.NO_CONTEXT, judging.NO_CONTEXT] and got[0][1] == "[Doc 1] a. b\n\n[Doc 2] "
    samples = spark.createDataFrame([(1, "q", None), (2, "q", "r")], "k int, query string, response string")
    assert [r.k for r in judging.faithfulness(samples, docs, key="k").collect()] == [1]
    assert judging.answer_quality(samples, lambda p: F.lit("7"), key="k").agg(F.sum("score")).first()[0] == 2.0
    near = spark.createDataFrame([("a", 1, "a"), ("a", 2, "b"), ("c", 1, "c")], "chunk_id string, pos int, neighbour string")
    asked = spark.createDataFrame([("a",), ("c",), ("d",)], "chunk_id string")
    assert {r.chunk_id: r.distractor for r in judging.with_distractor(asked, near).collect()} == {"a": "b", "c": "c", "d": "d"}


def test_filters_and_systems(spark):
    rows = spark.createDataFrame([(1, "multi_hop", "q", "a", ["t"]), (2, "single_hop", "q", "a", None), (3, "multi_hop", "q", "a", None)], "i int, kind string, query string, answer string, evidence array<string>")
    assert {r.i for r in taskgen.consistent(rows, lambda p: F.lit(" YES")).collect()} == {1, 2, 3}
    assert {r.i for r in taskgen.consistent(rows, lambda p: F.lit("no")).collect()} == {2}
    corpus = spark.createDataFrame([(1, "red apples grow. Here."), (2, "blue ships sail. There.")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "where do ships sail")], "item_id int, text string")
    got = systems.simple_rag(corpus)(asked, 1).first()
    assert got.retrieved == ["2_chunk_0"] and got.response == "blue ships sail."


def test_plan_targets_and_judged_plan(spark):
    plan = default_plan(5)
    assert set(plan.grouped_by_target()) == {"RETRIEVAL_RELEVANCE", "RETRIEVAL_ACCURACY", "GENERATION_CORRECTNESS", "GENERATION_FAITHFULNESS", "GENERATION_RELEVANCE"}
    with pytest.raises(ValueError, match="critic"):
        default_plan(judged=True)
    got = {r.metric: (r.target, r.value) for r in catalog.QUERIES["plan_results"](spark, SF).collect()}
    assert len(got) == 15 and got["mrr@5"][0] == "RETRIEVAL_ACCURACY" and got["recall@5"][0] == "RETRIEVAL_RELEVANCE" and got["evidence_overlap_n1"][1] > 0
    with_extras = default_plan(5, embed=lambda c: F.array(F.length(c)), critic=judging.mock_critic, judged=True)
    assert len(with_extras.metrics) == len(plan.metrics) + 4


def test_adapters(spark):
    def client():
        return lambda p: {"a": "A"}[p]

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, p string")
    assert [r.r for r in rows.orderBy("i").select(adapters.language_model(client, wait=0)("p").alias("r")).collect()] == ["A", None, None]
    vectors = rows.orderBy("i").select(adapters.embedder(lambda: lambda ts: [[float(len(t))] for t in ts], 1)("p").alias("v")).collect()
    assert [r.v for r in vectors] == [[1.0], [1.0], None]
    pairs = spark.createDataFrame([(1, "ab", "b"), (2, "", "x"), (3, None, "x")], "k int, l string, r string")
    assert [r.score for r in answers.embedded_similarity(pairs, "k", F.col("l"), F.col("r"), lambda c: F.array(F.length(c), F.lit(0))).orderBy("k").collect()] == [1.0, 0.0, 0.0]


class EchoSystem:
    def run(self, sample, top_k):
        if sample["query"] == "boom":
            raise ValueError("no answer")
        return {"response": sample["query"], "retrieved": [{"doc_id": "d1", "text": "red apples grow"}][:top_k]}


def test_evaluate_and_leaderboard_commands(spark, tmp_path):
    rows = [{"sample_id": "1", "query": "red apples", "relevant_docs": [{"doc_id": "d1", "text": "red apples grow"}], "reference_answer": {"text": "red apples"}}, {"sample_id": "2", "query": "boom", "reference_answer": {"text": "x"}}]
    (tmp_path / "set.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    path = commands.main(["evaluate", "--dataset", str(tmp_path / "set.jsonl"), "--rag", "tests.test_queries:EchoSystem", "--offline-critic", "--output-dir", str(tmp_path / "out"), "--system-name", "my echo"], spark)
    body = json.loads(Path(path).read_text())
    assert "offline_llm_answer_quality" in body["metrics"] and "llm_answer_quality" not in body["metrics"] and body["config"]["llm_metrics"] is False
    assert body["metrics"]["recall@5"]["value"] == 1.0 and body["metrics"]["exact_match"]["value"] == 0.5 and body["metrics"]["evidence_overlap_n1"]["value"] == 1.0
    (tmp_path / "out" / "bad.json").write_text("{")
    index = json.loads(Path(commands.main(["leaderboard", "--folder", str(tmp_path / "out")], spark)).read_text())
    assert [(r["system_name"], r["recall"], r["latency"]) for r in index] == [("my echo", 1.0, "N/A")]


def test_generate(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    config = TaskConfig(chunk_tokens=128, overlap=16, single_hop=6, multi_hop=3, least_answer=1, unanswerable=3)
    got = generate(docs, config, judge=lambda p: F.lit("yes"), folder=str(tmp_path)).collect()
    kinds = [r.labels["kind"] for r in got]
    assert kinds.count("single_hop") > 0 and kinds.count("unanswerable") > 0 and len({r.sample_id for r in got}) == len(got)
    for r in got:
        assert r.relevant_docs and ("variant_of" in r.labels) == ("paraphrase" in r.sample_id)
        assert r.labels["kind"] != "single_hop" or r.reference_answer.text.lower() in r.relevant_docs[0].text.lower()
    assert TaskConfig.sized(9).multi_hop == 4 and TaskConfig.sized(test=True).single_hop == 5
    assert Settings.read({"TAGGING_TEMPERATURE": "0.5"}).temperature == 0.5


def test_replies_are_parsed_by_line(spark):
    q, a = taskgen.parse_multi_hop(F.col("r"))
    told = lambda r: tuple(spark.createDataFrame([(r,)], "r string").select(q, a).first())
    assert told("intro\nQuestion: what is the answer: here?\n\n more\nAnswer: x\ny") == ("what is the answer: here? more", "x y")
    assert told("ANSWER: a\nquestion: q") == ("q", "a") and told(None) == told("nothing") == ("", "") and told("Question: only") == ("only", "")


def test_models_follow_the_settings():
    from ragscore.functions import adapters
    from ragscore.sources.settings import Settings

    mock = taskgen.mock_reply
    assert adapters.model_for(Settings(), mock) is mock and adapters.critic_for(Settings(backend="other", api_key="k"), mock) is mock
    assert adapters.model_for(Settings(api_key="k"), mock) is not mock


def test_rejected_replies_are_made_up_for(spark):
    from ragscore.plans.generation import TaskConfig, generate

    text = " ".join(f"In {1900 + i} the Great Harbour of Lisbon{i} held ten large ships and Maria Silva counted every one of them twice." for i in range(120))
    corpus = spark.createDataFrame([(i, text.replace("ships", f"ships{i}")) for i in range(4)], "doc_id long, text string")
    picky = lambda p: F.when(F.substring(F.md5(p), 1, 1) < "8", F.lit("")).otherwise(taskgen.mock_reply(p))
    config = TaskConfig(chunk_tokens=60, overlap=10, single_hop=6, multi_hop=2, least_answer=1, unanswerable=2, paraphrases=1)
    out = generate(corpus, config, llm=picky, filters=[]).toPandas()
    kinds = out.labels.map(lambda m: dict(m)["kind"]).value_counts()
    assert kinds["unanswerable"] <= 2 and (out[out.sample_id.str.startswith("single_hop:") & ~out.sample_id.str.contains("paraphrase")].shape[0]) == 6
    none = generate(corpus, config, filters=[lambda rows: rows.where("false")])
    assert none.count() == 0


def test_distractors_lend_their_sentence(spark):
    from ragscore.operators import judging

    chunks = spark.createDataFrame([("a", "Rome fell."), ("b", "Oslo stood. Rome rose again.")], "chunk_id string, text string")
    candidates = spark.createDataFrame([("a", "Rome", "Romx")], "chunk_id string, entity string, mutated string")
    near = judging.with_distractor(candidates, spark.createDataFrame([("a", 1, "b")], "chunk_id string, pos int, neighbour string"))
    echo = lambda p: F.concat(p, F.lit(" and so on"))
    assert "Rome rose again." in taskgen.unanswerable_tasks(near, chunks, echo).first().query and "Rome fell." in taskgen.unanswerable_tasks(candidates, chunks, echo).first().query
