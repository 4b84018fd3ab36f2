"""Spelling variants, whitening and secrets against brute force, with nulls, blanks, long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

op11 = pytest.importorskip("ragscore.llm.op11")
from ragscore.llm import op12, op13, registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows: list[tuple[int | None, str | None]]) -> dict[str, tuple]:
    count: Counter[str] = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: sorted((o for o in n if _near(w, o)), key=lambda o: (-n[o], o)) for w in n}
    form = {w: o[0] for w, o in near.items() if o and n[o[0]] >= 2 * n[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def _told(df) -> dict[str, tuple]:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _word_rows() -> list[tuple[int | None, str | None]]:
    r = random.Random(11)
    stems = ["maison", "garçon", "straße", "Ünder", "aaaaa", "lettre", "abcab"]
    rows: list[tuple[int | None, str | None]] = [(None, None), (1, ""), (2, "a bc"), (None, "maisons " * 9), (None, "maisons " * 9)]
    for i in range(3, 120):
        words = []
        for _ in range(40):
            w = r.choice(stems)
            k, p = r.randrange(8), r.randrange(len(w) + 1)
            w = w[:p] + r.choice("aeéZ") + w[p + (k == 1) :] if k < 2 else w[:p] + w[p + 1 :] if k == 2 else w
            words.append(w.upper() if k == 7 else w)
        rows.append((i, r.choice([" ", "×", "-"]).join(words)))
    return [*rows, *[(7, "tieda tieda tiedb tiedb tieda tiedb tiedc tiedc tiedc " * 2)] * 2, *[(200 + i, "tiede " * 3) for i in range(20)]]


def test_variants_equal_brute_force(spark):
    rows = _word_rows()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, word string, id int")
    want = _variants(rows)
    assert _told(op11.variant_groups(docs)) == want
    assert any(v[0] for v in want.values()) and any(v[3] > 1 for v in want.values())
    assert op11.variant_groups(docs.where("false")).count() == 0


def test_chains_of_forms_end_at_their_root(spark):
    chain = ["abcdefgh"[:i] + "zyxwvuts"[i:] for i in range(9)]
    rows = [(None, f"{w} " * (3 * 4**i)) for i, w in enumerate(chain[:7])]
    want = _variants(rows)
    assert _told(op11.variant_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert len({v[1] for v in want.values()}) < len(want)


def test_very_long_words(spark):
    r = random.Random(2)
    long = "".join(r.choice("abcdé") for _ in range(30_000))
    rows = [(1, " ".join([long] * 12)), (2, " ".join([long[:9] + "q" + long[10:]] * 3)), (3, " ".join([long[:-1]] * 4))]
    assert _told(op11.variant_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == _variants(rows)


def test_words_and_their_keys_are_never_broadcast(spark, monkeypatch):
    """The driver builds broadcasts, so no join may make one of words or keys, however small their files look."""
    plans = []
    monkeypatch.setattr(op11, "written", lambda df, name, keep=op11.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    rows = [(i, "letters lettera letterab letters letters letters lettera lettera other") for i in range(9)]
    out = op11.variant_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 4
    assert sum("SortMergeJoin" in plan for plan in plans) >= 3 and not any("Broadcast" in plan for plan in plans)


def test_delete_keys_are_those_of_the_deletions():
    words = ["abc", "aab", "ab", "aaaa", "éa", "abcd", "bcd"]
    row, key = op11.delete_keys(words)
    own = {w: k for w, k in zip(words, key, strict=False)}
    for i, w in enumerate(words):
        mine = [int(k) for k in key[len(words) :][row[len(words) :] == i]]
        shorter = {w[:j] + w[j + 1 :] for j in range(len(w))}
        assert len(mine) == len(shorter) == len(set(mine))
        assert {int(own[s]) for s in shorter if s in own} <= set(mine)


def _vectors(spark, x: list) -> object:
    return spark.createDataFrame([(i, v, "t", 5) for i, v in x], "vec_id long, embedding array<double>, component string, n int")


def _whitened(x: np.ndarray, fit: np.ndarray, k: int):
    n, total = len(fit), fit.sum(0)
    off = fit - total / n
    value, axes = np.linalg.eigh(off.T @ off / n)
    value, axes = value[::-1], axes[:, ::-1]
    return (x - total / n) @ axes[:, :k] / np.sqrt(value[:k]), value[:k] / value.sum(), [sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total, strict=True)) for v in x]


@pytest.mark.parametrize(("rows", "d"), [(400, 40), (60, 3), (30, 64)])
def test_whitening_equals_eigenvectors(spark, rows, d):
    r = np.random.default_rng(rows)
    x = r.normal(size=(rows, d)) * np.linspace(3, 0.5, d)
    x = np.r_[x, x[:25], x[:25]]
    bad = [(9000, None), (9001, [None] * d), (9002, [float("nan")] * d), (9003, [1.0] * (d - 1) + [float("inf")]), (9004, x[0].tolist())]
    got = op12.whitened(_vectors(spark, [(None if i == 1 else i, v.tolist()) for i, v in enumerate(x)] + bad)).toPandas()
    whole = np.floor(256 * np.r_[x, x[:1]]).astype(np.int64)
    fit = np.unique(whole, axis=0)
    k = min(4, d)
    want, explained, deviation = _whitened(whole, fit, k)
    assert len(got) == len(whole) * k and set(got.n) == {len(fit)} and got.identity_error.max() < 1e-9 and got.residual.max() < 1e-10
    ids = [-1 if i == 1 else i for i in range(len(x))] + [9004]
    got["vec_id"] = got.vec_id.fillna(-1).astype(int)
    for c in range(k):
        part = got[got.component == c + 1].set_index("vec_id").loc[ids]
        sign = np.sign(part.whitened.to_numpy() @ want[:, c])
        assert np.abs(part.whitened.to_numpy() - sign * want[:, c]).max() < 1e-8
        assert part.explained.to_numpy() == pytest.approx(explained[c], rel=1e-9) and part.deviation.tolist() == deviation


def test_whitening_of_odd_tables(spark):
    assert op12.whitened(_vectors(spark, [])).count() == 0 and op12.whitened(_vectors(spark, [(1, None), (2, [])])).count() == 0
    same = op12.whitened(_vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.n == 1 and r.deviation == 0 and r.explained is None and r.identity_error is None for r in same)
    line = op12.whitened(_vectors(spark, [(i, [i / 256, 2 * i / 256]) for i in range(5)] + [(9, [0.0])])).where("component = 2").collect()
    assert all(r.whitened is None and r.explained == 0 for r in line)  # rank one; [0.0] counts as [0, 0]
    big = op12.whitened(_vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).where("component = 1").collect()
    assert {r.deviation for r in big} == {(1 << 63) - 1, (3 * 0 - -1) ** 2 + (3 * 512 - 768) ** 2} and {r.n for r in big} == {3}


def test_lobpcg_on_equal_and_close_eigenvalues():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(300, 300)))[0]
    spectrum = np.r_[[5.0, 5.0, 4.0, 3.9999], np.linspace(3.99, 0.1, 296)]
    a = (q * spectrum) @ q.T
    value, axes, residual = op12.lobpcg(lambda b: a @ b, 300, 4)
    assert value == pytest.approx(spectrum[:4], abs=1e-9) and residual.max() < 5e-10 and np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12


_KEY, _HEX = "AKIA" + "Q7" * 10, "0123456789abcdef" * 2


def _base(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def _secret_rows() -> list[tuple[int | None, str | None]]:
    r = random.Random(13)
    pieces = [_KEY, _HEX, 'Password = "hunter2x"', "token=token:abcdefg", "API_KEY: 'Zz9+/abc='", "paſſword=abcdefgh", "secret : abc", "AKIASHORT", "client_id=ab12", "user: me", "login='x@y.example'", "https://db.example/x", "AbC1" * 6, "é" * 30, "word " * 45, "toKen\t=abcdefgh", "AKIA" + _KEY, "f" * 23, "passwd==abcdef", "redis://h:1", "\n"]
    rows: list[tuple[int | None, str | None]] = [(None, None), (None, ""), (1, "no secrets here"), (2, "é " * 5000 + f"user=abcdef {_KEY} secret=abcdef1"), (3, f"{_HEX} " * 3000 + "client_id: abcd")]
    rows += [(i, r.choice(["", " "]).join(r.choice(pieces) for _ in range(r.randrange(1, 14)))) for i in range(4, 300)]
    return [*rows, rows[-1]]


def test_secrets_keep_all_base_spans(spark, monkeypatch):
    rows = _secret_rows()
    docs = spark.createDataFrame([(i, t, 1, "k", 3) for i, t in rows], "doc_id long, text string, n_hex int, kind string, row int")
    monkeypatch.setattr(spark.read.__class__, "parquet", lambda self, path, *a, keep=spark.read.__class__.parquet, **k: docs if path.startswith("fixture/") else keep(self, path, *a, **k))
    got = op13.op13_secret_scan(spark, "fixture").toPandas()
    told = lambda spans: ",".join(f"{op13.KINDS[k]}:{s}:{e}" for s, k, e in spans)
    want = Counter()
    for i, t in rows:
        b = _base(t or "")
        added = [(s, k, e) for s, k, e in _linked(t or "")]
        want[(i, *[sum(x[1] == k for x in b) for k in range(3)], hashlib.sha256(told(b).encode()).hexdigest(), told(sorted(b + added)))] += 1
    have = Counter((None if x.doc_id != x.doc_id else int(x.doc_id), x.n_assign, x.n_access, x.n_hex, x.base_sha256, x.spans) for x in got.itertuples())
    assert have == want
    kinds = {s.split(":")[0] for x in got.spans for s in x.split(",")}
    assert {"id", "secret", "endpoint", *op13.BASE} <= kinds


def _linked(text: str) -> list[tuple[int, int, int]]:
    """Weak parts by the rule itself, all pairs."""
    parts = list(op13.Scanner().parts(text))
    out = []
    for k, s, e in parts:
        near = [op13.KINDS[k2] for k2, s2, e2 in parts if max(s, s2) - min(e, e2) <= op13.SCOPE and (k, s) != (k2, s2)]
        i, c, ep = any(x in op13.IDENTIFIERS for x in near), any(x in op13.SECRETS for x in near), "endpoint" in near
        rule = {"id": c and ("assign" in near or ep), "secret": i and ("access" in near or ep), "endpoint": i and c}
        if rule.get(op13.KINDS[k]):
            out.append((s, k, e))
    return out


def test_weak_parts_need_their_complements(spark):
    far = " word" * 60
    rows = [(1, "client_id=abcd"), (2, "client_id=abcd secret=abcdefg"), (3, f"client_id=abcd{far} secret=abcdefg"), (4, "Ab1" * 8), (5, "Ab1" * 8 + " " + _KEY), (6, "user=abcd " + "Ab1" * 8), (7, "user=abcd https://h.example " + "Ab1" * 8), (8, "https://h.example"), (9, "https://h.example secret=abcdefg"), (10, f"user=abcd {_HEX}")]
    got = {r.doc_id: sorted(op13.KINDS[p.kind] for p in r.added) for r in op13.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: ["id"], 3: [], 4: [], 5: ["secret"], 6: [], 7: ["endpoint", "id", "secret"], 8: [], 9: [], 10: []}
    assert op13.secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op8_substring_dedup", "op9_suffix_array_dedup", "op11_spelling_variants", "op13_secret_scan"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    plain = lambda df: sorted(repr([None if pd.isna(v) else int(v) if isinstance(v, (int, float, np.number)) else v for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want) and len(got) > 0


def test_whitening_query(spark):
    got = registry.QUERIES["op12_embedding_whitening"](spark, SF)
    first = got.agg(F.count("*").alias("rows"), F.max("identity_error").alias("error"), F.max("residual").alias("residual")).first()
    assert first.rows == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").count() and first.error < 1e-9 and first.residual < 1e-12
