"""Anchors, spans and tasks of one hop: by hand, against SQL on odd ids, and what their plans shuffle."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragscore import catalog, oracle
from ragscore.functions import text
from ragscore.functions.md5 import joined_md5
from ragscore.operators import search, taskgen


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_best_sentences_of_a_text_are_those_by_hand():
    """Counts of words, capitals and digits over odd blanks and letters, against plain Python."""
    r, alphabet = random.Random(5), ["a", "B", "é", "Ü", "7", "\u0663", "²", " ", "  ", "\t", "\u2003", "\u3000 ", ".", "..", ". ", "word ", "Big one ", "x ", "y\n", "\x85"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(160))) for _ in range(1500)] + [None, "", " ", "."]

    def by_hand(text):
        out, at = [], 0
        for piece in (text or "").split("."):
            w = [x for x in re.split(f"[{taskgen.BLANKS}]+", piece) if x]
            digit = any(unicodedata.category(c) == "Nd" or c in "²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉" for c in piece)
            score = 1.0 * (10 <= len(w) <= 50) + 0.5 * any(unicodedata.category(x[0]) == "Lu" for x in w) + 0.5 * digit
            out, at = out + [(-score, at, piece.strip(taskgen.BLANKS))] * (score > 0), at + len(piece) + 1
        return [{"sentence": s, "start_char": at, "score": -less} for less, at, s in sorted(out)[:3]]

    assert taskgen._best_sentences(pa.array(texts, pa.string()), 3).to_pylist() == [by_hand(t) for t in texts]


def test_filtered_tasks_shuffle_no_text_and_ask_once(spark, tmp_path):
    """Where no id repeats neither texts nor sentences are shuffled, and filters repeat neither the span nor the question."""
    taken = {}
    for name, odd in (("once", []), ("twice", [(1, "Also Ann Lee was here. nobody Else Came to"), (None, "A Nil Text has 2 words"), (None, "B Nil Text has 3 words")])):
        texts = [(1, "We met Ann Lee in 1999. the Second Sentence stands Here. no"), (2, "x Y Zed Tower. " * 300), (3, None), (4, " .")]
        spark.createDataFrame(texts + odd, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for q in ("filtered_tasks_mock", "answer_presence_filter", "single_hop_tasks_mock"):
            df = catalog.QUERIES[q](spark, f"{tmp_path}/{name}")
            taken[name, q] = sorted(map(tuple, df.collect()))
            if name == "once":
                plan = _plan(df)
                assert "Exchange" not in plan and "Join" not in plan
                assert plan.count("{Lu}\\S*+(?:") == 1 and plan.count("write a question") <= 1
    old = taskgen.extract_anchors(taskgen.chunk_documents(spark.read.parquet(f"{tmp_path}/once/documents.parquet")))
    assert taken["once", "single_hop_tasks_mock"] == sorted(map(tuple, taskgen.single_hop_tasks(old).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/twice/documents.parquet/*.parquet')")
    for q in ("filtered_tasks_mock", "answer_presence_filter"):
        assert taken["twice", q] == sorted(con.execute(oracle.SQL[q]).fetchall())


@pytest.mark.parametrize(("least", "most"), [(0, 2), (1, 3), (2, 2), (3, 2), (0, 0)])
def test_words_are_numbered_as_they_are_split(spark, least, most):
    rows = spark.createDataFrame([(t,) for t in (None, "", " ", "a", " a ", "a b", "a\u3000b\x85", "a  b c\n", "a b c d", "\t")], "t string")
    assert all(x.got == x.want for x in rows.select(text.number_of_words(F.col("t"), least, most).alias("got"), F.size(text.words(F.col("t"))).between(least, most).alias("want")).collect())


def test_a_plan_makes_each_view_once(spark, monkeypatch):
    """Ranked runs and samples are read by several metrics of the default plan; their rows are made once."""
    made, sf = {}, "/root/testdata/sf0.001"
    for name in ("passage_run", "passage_gold", "qa"):
        made[name] = spark.sparkContext.accumulator(0)

        def counted(s, d, plain=getattr(catalog.X, name), rows_made=made[name]):
            def count(batches):
                for batch in batches:
                    rows_made.add(batch.num_rows)
                    yield batch

            rows = plain(s, d)
            return rows.mapInArrow(count, rows.schema)

        made[name] = made[name], getattr(catalog.X, name)(spark, sf).count()
        monkeypatch.setattr(catalog.X, name, counted)
    assert len(catalog.QUERIES["plan_results"](spark, sf).collect()) == 15
    assert {name: seen.value for name, (seen, _) in made.items()} == {name: n for name, (_, n) in made.items()}


def test_md5_of_joined_texts_is_that_of_hashlib():
    heads, tails = [b"", b"a:", b"pairs:12_chunk_3:", b"x" * 54, b"y" * 55, b"z" * 200, "é:".encode()], [b"", b"7", b"123456_chunk_10", b"\xff" * 33, b"q" * 55, b"w" * 90]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(heads)), np.arange(len(tails))))
    want = [int.from_bytes(hashlib.md5(heads[x] + tails[y]).digest()[:8]) for x, y in zip(i, j, strict=True)]
    assert joined_md5(heads, tails)(i, j).tolist() == want and not len(joined_md5(heads, tails)(i[:0], j[:0]))


@pytest.mark.parametrize(("least", "postings"), [(1, 1 << 18), (2, 1 << 18), (2, 3), (3, 40)])
def test_edges_of_two_blocks_are_those_by_hand(monkeypatch, least, postings):
    monkeypatch.setattr(taskgen, "POSTINGS", postings)
    r = random.Random(8)
    names, other = ([sorted({str(r.randrange(12)) for _ in range(r.randrange(6))}) for _ in range(n)] for n in (90, 70))
    one, two = (taskgen._Block(pa.array(range(len(x))), pa.array(x, pa.list_(pa.string()))) for x in (names, other))
    for right, sets, same in ((two, other, False), (one, names, True)):
        got = [e for found in taskgen._edges_of(one, right, least, same) for e in zip(*(x.tolist() for x in found), strict=True)]
        want = [(a, b, len(set(x) & set(y))) for a, x in enumerate(names) for b, y in enumerate(sets) if len(set(x) & set(y)) >= least and (a < b or not same)]
        assert sorted(got) == want and len(want) > 20


def test_drawn_neighbours_are_those_of_the_least_whole_digest():
    """Whatever the order of the edges, and where the first bytes of digests are equal."""
    r, held = np.random.default_rng(3), {n: taskgen._Drawn(n, pa.array([f"{n}_{i}" for i in range(20)]), "pairs") for n in range(3)}
    one, best = held[0], {}
    for _ in range(40):
        number, mine, far = int(r.integers(3)), r.integers(0, 20, 30), r.integers(0, 20, 30)
        at = joined_md5(one.heads, held[number].tails)(mine, far) >> np.uint64(60)
        one.draw(mine, far, at, number, held)
        for x, y in zip(mine.tolist(), far.tolist(), strict=True):
            best[x] = min(best.get(x, (b"\xff" * 17,)), (one.digest(x, held[number].tails[y]), number, y))
    assert {x: (int(one.far_block[x]), int(one.far[x])) for x in best} == {x: b[1:] for x, b in best.items()}


def test_spans_are_found_in_slices_and_sent_once_a_group(spark, monkeypatch):
    """Against plain Python, over odd blanks; a span goes to a group as itself, not with each word that holds it."""
    monkeypatch.setattr(taskgen, "SPANS", 37)
    r = random.Random(4)
    some = lambda n: "".join(r.choice(["ab", "a", "B", "cé", " ", "  ", "\t", "　", "abcab", "\U00010400"]) for _ in range(r.randrange(n)))
    texts, spans = [some(30) for _ in range(120)] + [None, ""], sorted({some(6) for _ in range(400)} | {"", " ", "　", "abcabab"})
    left, right = pa.table({"text": pa.array([t or "" for t in texts], pa.string())}), pa.table({"span": pa.array([s for s in spans if s], pa.string())})
    got = sorted((i, s) for i, found in taskgen._searched(left, right) for s in found)
    assert got == sorted((i, s) for i, t in enumerate(texts) for s in spans if t and s.strip(taskgen.BLANKS) and s in t) and len(got) > 500
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    _, asked = taskgen._dealt(spark.createDataFrame([(s,) for s in [*spans, *spans, None]], "span string"), chunks)
    assert asked.count() == len(spans) - 1 and asked.columns == ["h", "span"]


def test_frequent_terms_are_weighed_where_their_text_is(spark, monkeypatch):
    """Vectors of documents of distinct ids, with frequent and rare terms, those asked for and others, by hand."""
    monkeypatch.setattr(search, "SHARE", 100)
    r = random.Random(6)
    texts = [(i, " ".join(r.choice(["alpha", "beta", "gamma", f"w{r.randrange(900)}"]) for _ in range(r.randrange(40)))) for i in range(500)] + [(500, None), (501, ""), (502, "x y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found, idf = search._unique_vectors(docs.select(F.col("doc_id").alias("id"), text.terms(F.col("text")).alias("terms")), lambda df: df.select("term", "df", F.col("term").isin("alpha", "w3", "w7").alias("asked"), (1.0 / F.col("df")).alias("idf")))
    n = Counter(w for _, t in texts for w in {x for x in (t or "").split() if len(x) > 1})
    assert {x.term: x.df for x in idf.collect()} == n
    want = {i: Counter(x for x in (t or "").split() if len(x) > 1) for i, t in texts}
    got = {x.id: x for x in found.collect()}
    assert set(got) == {i for i, w in want.items() if w}
    for i, x in got.items():
        assert dict(zip(x.terms, x.weights, strict=True)) == pytest.approx({w: c / n[w] for w, c in want[i].items() if w in ("alpha", "w3", "w7")})
        assert x["size"] == pytest.approx(sum((c / n[w]) ** 2 for w, c in want[i].items()) ** 0.5)
