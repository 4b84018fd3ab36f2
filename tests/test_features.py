"""Alignment, block top-k, substring and entity joins, quantiles, ordinals, model calls, sessions: against brute force and by hand."""

from __future__ import annotations

import json
import math
import random
import time
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragscore.functions import adapters, kernels, maps, skew
from ragscore.operators import answers, bertscore, blocks, judging, mergeable, robustness, search, taskgen
from ragscore.plans import commands, evaluate, generation, systems
from ragscore.sources import io
from ragscore.streaming import latency

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_alignment_by_hand(spark):
    table = {"cat": [1.0, 0.0], "dog": [0.6, 0.8], "sky": [0.0, -2.0], "nil": [0.0, 0.0]}
    embed = lambda tokens: F.transform(tokens, lambda t: F.when(t == "cat", F.array(F.lit(1.0), F.lit(0.0))).when(t == "dog", F.array(F.lit(0.6), F.lit(0.8))).when(t == "sky", F.array(F.lit(0.0), F.lit(-2.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0))))
    rows = [(1, "cat cat sky", "dog cat"), (2, "", "cat"), (3, None, None), (4, "nil", "cat"), (5, "sky", "cat dog nil")]
    df = spark.createDataFrame(rows, "k int, l string, r string")
    got = {x.k: x for x in bertscore.bert_score(df, "k", F.col("l"), F.col("r"), embed).collect()}

    def unit(t):
        v = np.array(table[t])
        return v / (np.linalg.norm(v) or 1)

    def mean(a, b):
        return float(np.mean([max(unit(x) @ unit(y) for y in b) for x in a])) if a and b else 0.0

    for k, left, right in rows:
        a, b = (left or "").split(), (right or "").split()
        p, r = mean(a, b), mean(b, a)
        assert (got[k].precision, got[k].recall) == pytest.approx((p, r)) and got[k].f1 == pytest.approx(2 * p * r / (p + r) if p + r > 0 else 0.0)
    idf = {x.k: x for x in bertscore.bert_score(df.where("k = 1"), "k", F.col("l"), F.col("r"), embed, idf=True).collect()}
    w = {"cat": 0.0, "dog": 0.0, "sky": math.log(2)}  # df 1 of 1 weighs nothing; sky is in no reference
    assert idf[1].precision == pytest.approx(sum(w[t] * max(unit(t) @ unit(y) for y in ("dog", "cat")) for t in ("cat", "cat", "sky")) / math.log(2)) and idf[1].recall == 0


def test_alignment_in_blocks():
    r = np.random.default_rng(3)
    a, b = r.normal(size=(70, 5)), r.normal(size=(31, 5))
    whole = a @ b.T
    for cells in (1, 40, 1 << 20):
        left, right = bertscore.best_matches(a, b, cells)
        assert left == pytest.approx(whole.max(1)) and right == pytest.approx(whole.max(0))
    assert [x.tolist() for x in bertscore.best_matches(a[:0], b[:2])] == [[], [0, 0]]


def test_bertscore_scores_pairs(spark):
    rows = spark.createDataFrame([(1, "red ship", "red ship"), (2, "red", "blue")], "k int, l string, r string")
    got = {x.k: x.score for x in bertscore.pair_score(kind="recall")(rows, "k", F.col("l"), F.col("r")).collect()}
    assert got[1] == pytest.approx(1) and got[2] < 0.9
    with pytest.raises(ValueError, match="unknown"):
        bertscore.pair_score(kind="f2")
    assert {m.metric for m in bertscore.mean_scores(spark.createDataFrame([(1, "a", None), (2, "a b", "")], "sample_id int, response string, reference string")).collect()} == {f"bertscore_{s}_reference" for s in bertscore.SCORES}
    with_tokens = evaluate.default_plan(5, token_embed=bertscore.hashed_vectors)
    assert len(with_tokens.metrics) == len(evaluate.default_plan(5).metrics) + 2


def test_spans_are_found_by_grams(spark):
    r = random.Random(5)
    letters = "abcé"
    texts = [(f"c{i}", " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(12)))) for i in range(60)] + [("n", None), ("e", ""), ("x", "abca  bc\nab"), ("x2", "hot " * 30)]
    spans = [None, "", " ", "a", "é", "abc", "zz", "abcabc", "ab ca", "a b", "bc\nab", "hot", "hot hot", "h", "abca  bc"] + [t[s : s + r.randrange(1, 12)] for _, t in texts[:40] for s in [r.randrange(max(1, len(t)))]]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string")
    found = taskgen.find_relevant(spark.createDataFrame([(s,) for s in spans], "span string"), chunks)
    want = {(s, c) for s in spans if s and s.strip() for c, t in texts if s in (t or "")}
    got = [(x.span, x.chunk_id) for x in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "NestedLoop" not in _plan(taskgen.words_with(spark.createDataFrame([("a",)], "part string"), spark.createDataFrame([("ab",)], "word string")))


def test_frequent_words_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(taskgen, "BLOCK", 3)
    chunks = spark.createDataFrame([(f"c{i}", "the same words" if i % 3 else "others here") for i in range(40)], "chunk_id string, text string")
    got = taskgen.find_relevant(spark.createDataFrame([("same",), ("e",), ("the same",)], "span string"), chunks).groupBy("span").count().collect()
    assert {x.span: x["count"] for x in got} == {"same": 26, "e": 40, "the same": 26}


def _odd_sentences():
    r = random.Random(5)
    parts = ["The", "A", "Al", "Anna", "(Bern)", "\"Élan", "it", "x.", "...", "[Z]", "Zoë!", "IT", "'", "straße", "Ωmega,", "3rd", "Of", "\U00010400b", "Q:"]
    gaps = [" ", " ", " ", "  ", "\u2003", "\n"]
    return [(f"c{i}", "".join(r.choice(["", " "]) + r.choice(parts) + r.choice(gaps) for _ in range(r.randrange(12)))) for i in range(300)] + [("n", None), ("b", " \u2003 ")]


def test_entities_without_a_shuffle_of_words(spark):
    rows = _odd_sentences()
    found = taskgen.extract_entities(spark.createDataFrame(rows, "chunk_id string, text string"))
    want = set()
    for key, text in rows:
        run = []
        for w in [x.strip(taskgen.EDGE) for x in (text or "").split()] + [""]:
            if w and unicodedata.category(w[0]) == "Lu":
                run += [w] if run or len(w) > 2 else []
            else:
                want |= {(key, " ".join(run))} if run and " ".join(run).lower() not in taskgen.STOP_ENTITIES else set()
                run = []
    assert "Window" not in _plan(found)
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_answer_spans_split_no_sentence_twice(spark):
    rows = _odd_sentences()
    found = taskgen.choose_answer_span(spark.createDataFrame(rows, "chunk_id string, sentence string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1
    for x in found.collect():
        w = (x.sentence or "").split()
        big = [unicodedata.category(t[0]) == "Lu" for t in w]
        at = next((i for i in range(1, len(w)) if big[i]), None)
        end = at and next((i for i in range(at, len(w)) if not big[i]), len(w))
        assert x.span == ((" ".join(w[at:end]) if at else w[-1]).strip(".,!?;:") if w else None)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_entity_graph_equals_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(taskgen, "BLOCK", 5)
    r = random.Random(least)
    sets = {f"c{i}": {"Hot"} | {f"E{int(r.expovariate(0.15))}" for _ in range(r.randrange(6))} for i in range(40)} | {"lone": {"Zed"}}
    rows = [(c, e) for c, es in sets.items() for e in es] + [("c1", "Hot")]
    got = {(x.src, x.dst): x.shared for x in taskgen.entity_graph(spark.createDataFrame(rows, "chunk_id string, entity string"), least).collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least}
    assert got == want


def test_one_python_worker_for_a_task_of_rouge_and_bertscore(spark):
    rows = [(1, "Running runs caresses", "run caressing ran"), (2, "", "abc"), (3, None, "x y"), (4, "the the cat", "the cats the"), (5, "x", None)]
    df = spark.createDataFrame(rows, "sample_id long, response string, reference string").withColumn("query", F.col("reference"))
    nodes = {}
    for kind in ("1", "2", "L"):
        scores = answers.rouge(df, kind)
        nodes[kind] = _plan(scores).count("ArrowEvalPython")
        got = {x.sample_id: x.score for x in scores.collect()}
        for key, p, t in rows[:4]:
            a, b = (kernels.rouge_stems((x or "").lower().split()) for x in (p, t))
            if kind == "L":
                shared, n = kernels.lcs_length(a, b), len(a) + len(b)
            else:
                k = int(kind)
                a, b = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (a, b))
                shared, n = sum((a & b).values()), sum(a.values()) + sum(b.values())
            assert got.pop(key) == pytest.approx(2 * shared / n if shared else 0.0)
        assert not got
    pairs = df.where("reference is not null")
    slow = bertscore.bert_score(pairs, "sample_id", F.col("response"), F.col("reference"), lambda t: bertscore.hashed_vectors(t))
    fast = bertscore.bert_score(pairs, "sample_id", F.col("response"), F.col("reference"))
    nodes["bertscore"] = _plan(fast).count("ArrowEvalPython")
    values = [{x.sample_id: (x.precision, x.recall, x.f1) for x in df.collect()} for df in (slow, fast)]
    assert values[0].keys() == values[1].keys() and all(values[0][k] == pytest.approx(values[1][k]) for k in values[0])
    assert nodes == {"1": 1, "2": 1, "L": 1, "bertscore": 1}


def test_facts_of_hot_and_rare_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "h" if i % 2 else f"k{i % 40}") for i in range(200)] + [(999, "none"), (1000, None)], "id long, key string")
    facts = rows.where("key <> 'none'").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = {x.key: (x.n, x.m) for x in facts.collect()}
    for share in (2, 10, 10_000):
        monkeypatch.setattr(skew, "SHARE", share)
        got = skew.joined_by_key(rows, facts, "key", "n").collect()
        assert len(got) == 202 and all((x.n, x.m) == want.get(x.key, (None, None)) for x in got)


def test_rows_of_hot_keys_are_dealt_to_all_tasks(spark):
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        rows = spark.range(2000).select("id", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise("hot").alias("key"))
        facts = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
        tasks = skew.joined_by_key(rows, facts, "key", "n").groupBy("key", F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for key, n in (("hot", 1600), (None, 400)):
        counts = [x["count"] for x in tasks if x.key == key]
        assert sum(counts) == n and len(counts) == 4 and max(counts) < n / 2


def test_sparse_top_k_equals_brute_force(spark, monkeypatch):
    for name, value in (("QUERY_BLOCK", 4), ("DOCUMENT_BLOCK", 7), ("POSTINGS", 11)):
        monkeypatch.setattr(blocks, name, value)
    r = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["the"] * 10
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.randrange(1, 40))) for i in range(50)] + [(60, None), (61, ""), (62, "the"), (63, "the")]
    queries = [(i, text(6)) for i in range(9)] + [(20, "unseen"), (21, None)]
    got = search.tfidf_topk(spark.createDataFrame(queries, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 6, stop_words=("w3",)).collect()
    tf = {i: Counter(w for w in (t or "").split() if w != "w3") for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    vec = lambda c: {w: n * idf[w] for w, n in c.items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1
    for i, t in queries:
        q = vec(Counter(w for w in (t or "").split() if w != "w3"))
        score = {d: round(sum(x * vec(c).get(w, 0) for w, x in q.items()) / (norm(q) * norm(vec(c))), 9) for d, c in tf.items()}
        want = sorted(score, key=lambda d: (-score[d], d))[:6]
        mine = sorted((x for x in got if x.item_id == i), key=lambda x: x.pos)
        assert [x.doc_id for x in mine] == want and [x.score for x in mine] == pytest.approx([score[d] for d in want], abs=1e-8)


def test_dense_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PIVOTS", 5)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 6)
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(80, 4)), r.normal(size=(1, 4)) + r.normal(size=(60, 4)) * 0.01])
    x = np.concatenate([x, x[:5], np.zeros((1, 4))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0]), (502, [float("nan")] * 4), (3, x[9].tolist())]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>")
    got = blocks.dense_top_k(corpus.where("id % 10 = 3"), corpus, 4, block=16)
    told = search._ranked(got.select("query_id", F.col("found").alias("vec_id"), F.round("score", 9).alias("score")).distinct(), "query_id", "vec_id", 4).collect()
    ids = np.r_[np.arange(len(x)), 3]
    whole = np.r_[x, x[9:10]]
    unit = whole / (np.linalg.norm(whole, axis=1, keepdims=True) + 1e-12)
    for q in [int(i) for i in sorted(set(ids)) if i % 10 == 3 and i != 3]:
        score = np.round(unit @ unit[q], 9)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:4]
        mine = sorted((t for t in told if t.query_id == q), key=lambda t: t.pos)
        assert [t.score for t in mine] == pytest.approx(score[order], abs=1e-8) and all(t.vec_id != q for t in mine)
    assert search.dense_knn(corpus.limit(0).toDF("vec_id", "embedding"), corpus.limit(0).toDF("vec_id", "embedding")).count() == 0


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_quantiles(spark, monkeypatch, q):
    monkeypatch.setattr(robustness, "ACCURACY", 20)
    r = random.Random(3)
    rows = [("a", r.gauss(0, 1)) for _ in range(700)] + [("b", 5.0)] * 300 + [("b", 6.0)] * 9 + [("c", 1.0), ("d", None), (None, 2.0), (None, 3.0)] + [("e", float(i % 7)) for i in range(500)]
    got = {x.key: (x.value, x.n) for x in robustness.exact_quantile(spark.createDataFrame(rows, "key string, value double").repartition(5), q).collect()}
    by: dict = {}
    for k, v in rows:
        if v is not None and k is not None:
            by.setdefault(k, []).append(v)
    assert {k: v for k, v in got.items() if k is not None} == {k: (sorted(v)[max(1, math.ceil(q * len(v))) - 1], len(v)) for k, v in by.items()}


def test_ordinals(spark, monkeypatch):
    monkeypatch.setattr(io, "SAMPLED", 200)
    r = random.Random(6)
    rows = [(i, r.choice([None, "same", "same", f"v{i:04}"]), {"m": i}) for i in range(900)]
    got = io.numbered(spark.createDataFrame(rows, "i int, at string, info map<string,int>").repartition(7), "at").collect()
    assert sorted(x.ordinal for x in got) == list(range(900)) and {x.i for x in got} == set(range(900))
    in_order = [x.at for x in sorted(got, key=lambda x: x.ordinal)]
    assert in_order == sorted(in_order, key=lambda v: (v is not None, v or ""))
    assert io.numbered(spark.createDataFrame([], "at string"), "at").count() == 0
    assert [x.ordinal for x in io.numbered(spark.createDataFrame([("a",)] * 3, "at string"), "at").collect()] == [0, 1, 2]


def test_corpus_choices(spark):
    demo = {x.doc_id: x for x in io.demo_corpus(spark).collect()}
    assert demo["2"].metadata == {"orig_meta": "meta2"} and demo["1"].text.startswith("Paris")
    rows = spark.createDataFrame([("t", "x", 1), ("v", "y", 2), ("t", None, 3)], "split string, body string, n int")
    got = io.load_corpus(rows, None, "body", lambda d: {"double": d.n * 2}, order="n", split="t").orderBy("doc_id").collect()
    assert [(x.doc_id, x.text, x.metadata) for x in got] == [("hf_doc_0", "x", {"double": "2"}), ("hf_doc_1", "", {"double": "6"})]


def test_single_file_and_console(spark, tmp_path):
    rows = spark.createDataFrame([("1", "q"), ("2", "é")], "sample_id string, query string")
    path = tmp_path / "set.jsonl"
    for _ in range(2):  # the second time over the first
        io.save_jsonl(rows, str(path), single_file=True)
    assert path.is_file() and sorted(json.loads(x)["query"] for x in path.read_text().splitlines()) == ["q", "é"] and not (tmp_path / "set.jsonl.parts").exists()
    assert io.load_jsonl(spark, str(path)).count() == 2
    results = spark.createDataFrame([(0, "T", "recall@5", 0.5, 3, 1)], "ordinal int, target string, metric string, value double, num_samples long, num_errors long")
    assert io.console(results).splitlines()[1].split("  ") == ["recall@5", "0.5000", '{"num_samples": 3, "num_errors": 1}']


def test_model_calls_run_side_by_side_and_are_retried(spark):
    def flaky():
        tried: Counter = Counter()

        def ask(prompt):
            tried[prompt] += 1
            time.sleep(0.05 if prompt.startswith("slow") else 0)
            if prompt == "bad" or (prompt == "twice" and tried[prompt] < 3):
                raise RuntimeError("no")
            return prompt.upper()

        return ask

    prompts = ["twice", "bad", None, *[f"slow{i}" for i in range(40)]]
    rows = spark.createDataFrame(list(enumerate(prompts)), "i int, p string").coalesce(1)
    ask = adapters.asked(flaky, workers=20, wait=0.01)
    got = [x.r for x in rows.select("i", ask(F.col("p")).alias("r")).orderBy("i").collect()]
    assert [x.reply for x in got] == ["TWICE", None, None, *[f"SLOW{i}" for i in range(40)]]
    assert [x.error for x in got][:3] == [None, "RuntimeError: no", None] and not any(x.error for x in got[3:])
    start = time.perf_counter()
    assert rows.where("p like 'slow%'").select(ask(F.col("p"))["reply"].alias("r")).count() == 40
    rows.where("p like 'slow%'").select(ask(F.col("p"))["reply"].alias("r")).collect()
    assert time.perf_counter() - start < 5


def test_lost_grades_are_counted_and_left_out(spark):
    samples = spark.createDataFrame([(1, "a", "0.5"), (2, "bad", "1"), (3, "c", "1")], "sample_id int, query string, response string")
    critic = lambda p: F.when(~F.contains(p, F.lit("bad")), F.regexp_extract(p, r"Answer:\n(\S+)", 1))
    got = answers.mean(judging.answer_quality(samples, critic), "llm_answer_quality", errors=True).first()
    assert (got.value, got.num_samples, got.num_errors) == (0.75, 2, 1)
    plan = evaluate.EvaluationPlan([evaluate.Metric("T", lambda v: answers.mean(judging.answer_quality(v["samples"], critic), "q", errors=True)), evaluate.Metric("T", lambda v: answers.mean(answers.exact_match(v["samples"].withColumn("reference", F.lit("1"))), "e"))])
    assert [x.num_errors for x in plan.run({"samples": samples}).orderBy("ordinal").collect()] == [1, 0]


def test_judged_runs_need_a_service(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    (tmp_path / "s.jsonl").write_text('{"sample_id": "1", "query": "q"}')
    with pytest.raises(ValueError, match="service"):
        commands.main(["evaluate", "--dataset", str(tmp_path / "s.jsonl"), "--rag", "tests.test_queries:EchoSystem", "--judged", "--output-dir", str(tmp_path / "out")], spark)
    assert not (tmp_path / "out").exists()


def test_generate_asks_the_model_of_the_settings(spark, tmp_path, monkeypatch):
    text = " ".join(f"In {1900 + i} the Great Harbour of Lisbon{i} held ten large ships and Maria Silva counted every one of them twice." for i in range(60))
    spark.createDataFrame([(i, text.replace("ships", f"ships{i}")) for i in range(3)], "doc_id long, text string").write.parquet(str(tmp_path / "corpus"))
    monkeypatch.setattr(commands, "has_service", lambda s: True)
    monkeypatch.setattr(commands, "model_for", lambda s, mock: lambda p: F.lit("What does the model of the settings want to know?"))
    out = commands.main(["generate", "--corpus", str(tmp_path / "corpus"), "--output", str(tmp_path / "set.jsonl"), "--limit", "3"], spark)
    asked = [json.loads(x) for x in open(out)]
    assert all(x["query"].startswith("What does the model") for x in asked if x["labels"]["kind"] == "single_hop" and "variant_of" not in x["labels"])


def test_answers_by_a_model(spark):
    corpus = spark.createDataFrame([(1, "red apples grow. Here."), (2, "blue ships sail. There.")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "where do ships sail")], "item_id int, text string")
    echo = systems.simple_rag(corpus, answer=judging.answerer(lambda p: F.concat(F.lit(" "), p, F.lit("\n"))))(asked, 1).first().response
    assert judging.NO_ANSWER in echo and echo.endswith("Context:\nDoc 1: blue ships sail. There.\n\nQuestion: where do ships sail\n\nAnswer:")
    empty = spark.createDataFrame([("q", None)], "q string, e array<string>").select(judging.answer_prompt(F.col("q"), F.col("e"))).first()[0]
    assert "Context:\n\n\nQuestion: q" in empty


def test_misleading_documents(spark):
    chunks = spark.createDataFrame([("a", "ships sail far"), ("b", "apples grow"), ("c", "ships rest")], "chunk_id string, text string")
    asked = spark.createDataFrame([("s1", "which ships rest", ["b"]), ("s2", "nothing shared", ["b"])], "sample_id string, query string, chunks array<string>")
    got = {x.sample_id: x.chunks for x in generation.misleading(asked, chunks, 2).collect()}
    assert got == {"s1": ["c", "a"], "s2": ["a", "b"]}  # without a shared term the first ids stand in, as in retrieval


def test_labels_merge_to_the_right(spark):
    df = spark.range(1).select(maps.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), maps.known(b=F.lit(3), c=F.lit(None), d=F.lit("x"))).alias("m"), maps.merged(F.lit(None).cast("map<string,string>"), maps.known(k=F.lit("v"))).alias("n"))
    assert df.first().m == {"a": "1", "b": "3", "d": "x"} and df.first().n == {"k": "v"}
    rows = spark.createDataFrame([("1", "q", [("d", "t")], "a", {"kind": "x", "own": "y"}, "single_hop")], "sample_id string, query string, relevant_docs array<struct<doc_id:string,text:string>>, answer string, labels map<string,string>, kind string")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("scenario", "variant_of", "source_entity")})
    assert generation.as_samples(rows).first().labels == {"kind": "single_hop", "own": "y"}


def test_mergeable_metrics_by_hand(spark):
    rows = [(1, "the cat sat on it", "the cat sat on it", None, None), (2, "a b c d e", "a b c d x", 1, "typo"), (3, None, "x y", 1, "paraphrase"), (4, "p q", None, None, "plain"), (5, "a a a a", "a a a a", None, "paraphrase")]
    df = spark.createDataFrame(rows, "sample_id int, response string, reference string, variant_of int, scenario string")
    assert mergeable.evaluated(mergeable.bleu(), df).first()["value"] == answers.bleu(df).first()["value"]
    assert mergeable.evaluated(mergeable.distinct(2), df).first() == answers.distinct_n(df, 2).first()
    mean = mergeable.evaluated(mergeable.mean_of("token_f1", answers.token_f1), df).first()
    assert (mean.value, mean.num_samples) == tuple(answers.mean(answers.token_f1(df), "token_f1").first())[1:]
    noise = mergeable.noise_robustness(mergeable.mean_of("token_f1", answers.token_f1), df).first()
    assert noise == robustness.noise_robustness(df.where("reference is not null"), answers.token_f1(df), "token_f1").first()
    two = mergeable.noise_robustness(mergeable.distinct(1), df).first()  # row 5 is base and noise
    assert (two.base_samples, two.noise_samples, two.base_score) == (3, 3, round((5 + 2 + 1) / 11, 6))
    parts = {(x.scenario, x.level): (x.value, x.num_samples) for x in mergeable.sliced(mergeable.distinct(1), df, "scenario").collect()}
    assert parts[None, "total"] == (0.75, 5) and parts["typo", "scenario"] == (1.0, 1) and parts[None, "scenario"] == (1.0, 1)
    none = mergeable.noise_robustness(mergeable.bleu(), df.where("false")).first()
    assert (none.value, none.base_samples) == (0, 0)
    assert kernels.ngram_statistics(["a", "a"], ["a"], 2) == [2, 1, 1, 2, 0, 1]


def test_a_stream_of_sessions_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    days = [0, 6, 12, 18, 24, 99]
    for a, b in zip(days, days[1:], strict=False):  # one file after the other, as the source takes them by age
        events.where(f"datediff(ts, '2024-01-01') >= {a} and datediff(ts, '2024-01-01') < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = latency.sessions_stream(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {tuple(x) for x in spark.table("sessions").collect()}
    closed = latency.latency_sessions(events).where(F.col("session_end") <= F.lit(events.agg(F.max("ts") - F.expr("interval 10 minutes")).first()[0]))
    want = {tuple(x) for x in closed.collect()}
    assert got and got == want


def test_legacy_rouge_keeps_blank_references(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (2, "a", ""), (3, "a", None)], "sample_id int, response string, reference string")
    assert {x.sample_id: x.score for x in answers.rouge_l_legacy(df).collect()} == {1: 1.0, 2: 0.0}
    assert answers.rouge(df, "L").count() == 1


def test_sql_of_stems_and_hashes_equals_the_kernels():
    import duckdb
    import pandas as pd

    from ragscore import oracle_text
    from ragscore.functions import kernels

    heads = ["", "b", "tr", "oa", "hop", "plast", "yy", "sky", "toy", "fizz", "controll", "agr", "syllabl", "2n", "xyz"]
    tails = [*kernels.PORTER_STEP4, *[old for old, _ in kernels.PORTER_STEP2 + kernels.PORTER_STEP3], "", "s", "sses", "ies", "eed", "ed", "ing", "ping", "lled", "y", "e", "ll", "yyed"]
    w = pd.DataFrame({"t": sorted({h + t + more for h in heads for t in tails for more in ("", "s", "e", "é")} - {""})})
    con = duckdb.connect()
    con.register("w", w)
    plain = "SELECT t FROM w WHERE NOT contains(t, 'é')"
    stems = con.execute(f"WITH {oracle_text.stems(plain)} SELECT * FROM st_").fetchall()
    assert len(stems) > 1000 and all(kernels.porter_stem(t) == stem for t, stem in stems)
    buckets = con.execute(f"WITH {oracle_text.murmur3('SELECT t FROM w')} SELECT * FROM mm_").fetchall()
    assert len(buckets) == len(w) and all(abs(kernels.murmur3(t)) % 4096 == b for t, b in buckets)


def test_sentences_are_scored_once(spark):
    """Each text is split into words once, and no filter repeats the patterns of a sentence's score."""
    odd = [(1, "  A b. . ..x Yes  \u00c9\u0085 one. 3 v\u0661. " + "w " * 9 + "q.\u3000" + "w " * 10 + "." + "w " * 51 + ". Zed\n"), (2, "....."), (3, None), (4, " "), (5, "xA yB. x\U00010400 \U00010400a.")]
    anchors = taskgen.extract_anchors(taskgen.chunk_documents(spark.createDataFrame(odd, "doc_id long, text string"), 100, 10))
    plan = _plan(anchors)
    assert plan.count("(?U)\\s+") == 1 and plan.count("{Lu}") == 1
    got = [(x.chunk_id, x.pos, x.sentence, x.score) for x in anchors.orderBy("chunk_id", "pos").collect()]
    assert got == [("1_chunk_0", 1, "w " * 9 + "q", 1.0), ("1_chunk_0", 2, "w " * 9 + "w", 1.0), ("1_chunk_0", 3, "A b", 0.5), ("5_chunk_0", 1, "x\U00010400 \U00010400a", 0.5)]


@pytest.mark.parametrize("least", [1, 2])
def test_the_graph_is_summed_up_where_it_is_found(spark, monkeypatch, least):
    """Degrees and drawn neighbours equal those of the edges, in several blocks, and no edge goes through a shuffle."""
    monkeypatch.setattr(taskgen, "EDGES", 7)
    r = random.Random(least)
    rows = [(f"c{i}", f"E{int(r.expovariate(0.15))}") for i in range(1100) for _ in range(r.randrange(4))] + [("c1", None), (None, "E1"), ("lone", "Zed")]
    entities = spark.createDataFrame(rows, "chunk_id string, entity string")
    edges = taskgen.entity_graph(entities, least).persist()
    flat = lambda df: sorted(map(tuple, df.collect()))
    assert edges.count() > 1000 and edges.distinct().count() == edges.count() == edges.where("src < dst").count()
    assert flat(taskgen.graph_degree(entities, least)) == flat(taskgen.entity_degree(edges))
    assert flat(taskgen.graph_pairs(entities, least=least)) == flat(taskgen.sample_pairs(edges))
    edges.unpersist()
    for df in (taskgen.entity_graph(entities, least), taskgen.graph_degree(entities, least)):
        product = _plan(df).split("CartesianProduct")
        assert len(product) == 2 and "Join" not in product[0]  # edges meet nothing after they are found


def test_spans_are_counted_where_they_are_found(spark, monkeypatch):
    """A shuffle before the last one carries words of groups of chunks, the last one a row for each span and group: no pairs of span and chunk."""
    monkeypatch.setattr(taskgen, "BLOCK", 50)
    chunks = spark.createDataFrame([(f"c{i}", f"the same words {i % 7} x") for i in range(400)], "chunk_id string, text string")
    spans = spark.createDataFrame([(s,) for s in ("a", "same", "the same", "6", "7 x", "zz", None, "5 x")], "span string")
    found = taskgen.relevant_counts(spans, chunks)
    assert {x.span: x.n_chunks for x in found.collect()} == {"a": 400, "same": 400, "the same": 400, "6": 57, "5 x": 57}
    above = _plan(found).split("CoGroup")[0]
    assert above.count("Exchange") == 1 and "Join" not in above
    assert "Join" not in _plan(taskgen.find_relevant(spans, chunks)).split("CoGroup")[0]
