"""The training-data operators against brute force on small fixtures with nulls, blanks, ties, repeats and extra columns."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

op1 = pytest.importorskip("ragscore.llm.op1")
from ragscore.llm import common, op2, op3, op4, op5, op6, op7, op8, op9, op10, repeats  # noqa: E402
from ragscore.llm import near_documents as near_documents_module  # noqa: E402
from ragscore.llm.labelled_pages import labelled_page  # noqa: E402
from ragscore.llm.near_documents import near_documents  # noqa: E402

SF = "/root/testdata/sf0.001"


def _texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(4)
    words = ["wa", "lo", "mí", "ne", "tu", "sha", "è"]
    base = " ".join(r.choice(words) for _ in range(90))
    rows: list[tuple[int | None, str | None]] = [(1, base), (2, None), (3, ""), (4, "  \n"), (5, base), (6, "x " + base[7:]), (7, "a b"), (8, "ab " * 200), (9, "Zé" * 150), (None, base[5:260])]
    for i in range(10, 40):
        s = r.randrange(60)
        rows.append((i, " ".join(r.choice(words) for _ in range(r.randrange(40))) + base[s : s + r.randrange(300)]))
    return [*rows, (5, base)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 7, "clash") for i, t in _texts()], "doc_id long, text string, lang string, n_units int, kept string")


def _brute(unit: str, width: int) -> dict:
    rows = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in _texts()})
    seen, out = set(), {}
    for i, t in rows:
        raw = t.encode()
        units = raw if unit == "byte" else raw.split()
        gone = bytearray(len(units))
        for s in range(len(units) - width + 1):
            w = bytes(units[s : s + width]) if unit == "byte" else tuple(units[s : s + width])
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        left = [u for u, g in zip(units, gone, strict=True) if not g]
        out[i] = (len(units), sum(gone), bytes(left) if unit == "byte" else b" ".join(left))
    return out


@pytest.mark.parametrize("hot", [256, 1])
@pytest.mark.parametrize(("unit", "width", "f"), [("byte", 100, op9.suffix_array_dedup), ("word", 20, op8.substring_dedup)])
def test_repeats(docs, unit, width, f, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = f(docs, carry=["lang", "kept"]).collect()
    assert len(got) == len(_texts()) and got[0].lang == "en"
    assert {(-(1 << 63) if r.doc_id is None else r.doc_id): (r.n_units, r.n_removed, bytes(r.kept)) for r in got} == _brute(unit, width)


def test_long_text_is_cut_into_blocks(monkeypatch):
    from ragscore.llm import passages as P

    monkeypatch.setattr(P, "BLOCK", 5000)
    text = b" ".join(b"w%d" % (i % 4000) for i in range(9000))
    for unit in ("byte", "word"):
        seen = 0
        for _, units in P.blocks([b"a b", text, b"c"], 20, unit):
            runs = P.scan(units, P.Prefix(units.values), 20, 8)
            seen += int(runs.count.sum())
        assert seen == (len(text) - 19 if unit == "byte" else 9000 - 19)


def test_texts_of_several_blocks(spark):
    from ragscore.llm import passages as P

    r = random.Random(12)
    base = [f"{r.randrange(10**6)}" for _ in range(100_000)]
    other = [w if i % 97 else f"x{i}" for i, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(other))]
    assert min(len(t) for _, t in rows) > P.BLOCK
    seen = {tuple(base[s : s + 20]) for s in range(len(base) - 19)}
    gone = np.zeros(len(other), bool)
    for s in range(len(other) - 19):
        if tuple(other[s : s + 20]) in seen:
            gone[s : s + 20] = True
    got = {x.doc_id: x for x in op8.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and bytes(got[2].kept) == " ".join(w for w, g in zip(other, gone, strict=True) if not g).encode()


def test_words_of_equal_polynomial_hash_differ(spark):
    abba = "a"
    while len(abba) < 1024:
        abba += abba.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{head} {abba}"), (2, f"{head} " + abba.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert [r.n_removed for r in op8.substring_dedup(docs).collect()] == [0, 0]


def test_task_remembers_contents():
    known = repeats.Lately()
    one = lambda k, c, d, x: known.knows(*(np.array([v], t) for v, t in zip((k, c, d, x), (np.uint64, np.uint64, np.int64, np.int64), strict=True)))[0]
    assert not one(1, 2, 5, 0) and one(1, 2, 6, 0) and not one(1, 2, 5, 0) and not one(1, 3, 6, 0) and not one(1, 2, 4, 9) and one(1, 2, 5, 0)


def test_simhash_components(docs):
    got = op4.simhash_near_dedup(docs, carry=["lang"]).collect()
    prints = {i: op4.fingerprint((t or "").encode()) for i, t in _texts()}
    ids = sorted(prints, key=lambda i: -(1 << 63) if i is None else i)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    low = min(group[a], group[b], key=lambda i: -(1 << 63) if i is None else i)
                    if group[a] != low or group[b] != low:
                        group[a] = group[b] = low
                        changed = True
    assert {r.doc_id: r.component_id for r in got} == group
    assert prints[2] == prints[3] == prints[4] == 0


def test_random_fingerprints_link_exactly(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = sorted({b ^ sum(1 << r.randrange(64) for _ in range(k)) & ((1 << 64) - 1) for b in base for k in range(4)} | set(base))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = op4.near_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    from ragscore.llm.op7 import _forest

    want = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    u, v = _forest(np.array([signed[a] for a, _ in want]), np.array([signed[b] for _, b in want]))
    gu, gv = _forest(np.array([x.u for x in links]), np.array([x.v for x in links]))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == dict(zip(gu.tolist(), gv.tolist(), strict=True))


def test_near_documents(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(900)]
    text = [r.choice(words) for _ in range(300)]
    near = [*text[:150], "changed", *text[151:]]
    other = [r.choice(words) for _ in range(300)]
    rows = [(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(other)), (4, " ".join(text)), (5, None), (6, "")]
    got = {r.doc_id: r.component_id for r in near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5}


@pytest.mark.parametrize("kind", ["hot passage", "short", "threshold", "large group"])
def test_near_documents_by_brute_force(spark, kind, monkeypatch):
    from ragscore.llm.near_documents import shingle_hashes

    r = random.Random(21)
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(120)]
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    if kind == "hot passage":
        for _ in range(60):
            add([*(word() for _ in range(r.choice([10, 15, 20, 25, 40]))), *passage])
        for size in [15, 25, 40, 80] * 4:  # near copies, edited in their own words
            own = [word() for _ in range(size)]
            add([*own, *passage])
            own[r.randrange(size)] = "edit"
            add([*own, *passage])
    if kind == "short":  # one word edited or added
        for size in [1, 3, 5, 12, 15, 20, 30, 30, 40, 60] * 4:
            text = [word() for _ in range(size)]
            add(text)
            add([*text, "more"])
            text[r.choice([0, r.randrange(size)])] = "edit"
            add(text)
    if kind == "threshold":  # long texts on both sides of it
        for gone in range(20, 44, 2):
            text = [word() for _ in range(600)]
            add(text)
            for at in range(gone):
                text[at * 600 // gone] = "edit%d" % at
            add(text)
    if kind == "large group":  # edits of one text, on both sides of the threshold from each other
        text = [word() for _ in range(145)]
        for _ in range(120):
            edited = list(text)
            for _ in range(r.choice([1, 1, 2, 3, 4])):
                edited[r.randrange(145)] = word()
            add(edited)
    tables, write = [], near_documents_module.written
    monkeypatch.setattr(near_documents_module, "written", lambda df, name: tables.append(name) or write(df, name))
    sets = [set(shingle_hashes(t.encode()).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            prints = [op4.fingerprint(rows[k][1].encode(), 5) for k in (i, j)]
            if len(a & b) / len(a | b) >= 0.8 or (prints[0] ^ prints[1]).bit_count() <= 2:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(group))
    assert kind != "large group" or tables.count("placed") > 1


def test_top_k_and_vectors(spark):
    r = np.random.default_rng(2)
    vectors = [[float(x) for x in v] for v in r.normal(size=(300, 8))]
    vectors[7] = vectors[8] = vectors[9]
    vectors[11] = [x * 1.0001 for x in vectors[12]]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(300, None, "x"), (301, [float("nan")] * 8, "x"), (302, [0.0] * 8, "x"), (303, [None] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in op2.exact_top_k(df.where("vec_id % 50 = 0"), df).collect()}
    f = np.floor(256 * np.array([[np.float64(np.float32(x)) for x in v] for v in [*vectors, [0.0] * 8]]))
    ids = [*range(300), 302]
    want = {}
    for q in range(0, 300, 50):
        s = sorted(((-int(f[q] @ f[j]), ids[j]) for j in range(len(ids)) if ids[j] != q))[:5]
        want |= {(q, k + 1): (i, -v) for k, (v, i) in enumerate(s)}
    assert {k: v for k, v in got.items() if k[0] < 300} == want
    near = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in op7.embedding_near_dedup(df).collect()}
    assert len(near) == 304 and near[9] == (2, 7, False) and near[12] == (1, 11, False) and near[302] == (0, 302, True) and near[300] == (0, 300, True)


def test_bpe_and_packing(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(op5.default_path())
    extra = spark.createDataFrame([(100, "It's <|endoftext|> ÉΣς İ x\t\r\n'RE 12½ 漢字"), (101, "long " * 6000)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(extra)
    for r in op5.bpe_round_trip(table).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    pieces = op3.best_fit_pack(table).toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 4096
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
    ids = np.array([*library.encode("long " * 6000, add_special_tokens=False).ids, 1], "<u4")
    assert list(pieces[pieces.doc_id == 101].sort_values("piece").ids_crc32) == [zlib.crc32(ids[s : s + 4096].tobytes()) for s in range(0, len(ids), 4096)]
    assert op3.best_fit_pack(table.where("false")).count() == 0


def test_packing_plan_is_whole():
    counts = np.bincount(np.random.default_rng(3).integers(1, 101, 5000), minlength=101)
    runs = op3.plan(counts, 100)
    filled: dict[int, int] = {}
    for size, _, pieces, first, many, _ in runs:
        for i in range(pieces):
            filled[first + i // many] = filled.get(first + i // many, 0) + size
    assert max(filled.values()) <= 100 and sum(filled.values()) == sum(i * c for i, c in enumerate(counts))
    assert len(filled) <= 1.02 * -(-sum(filled.values()) // 100) + 1


def test_extraction(spark):
    r = random.Random(123)
    pages = [(i, labelled_page(r)) for i in range(40)] + [(98, None), (99, "")]
    model = op6.trained(150)
    got = {x.page_id: x.blocks for x in op6.extract_text(spark.createDataFrame(pages, "page_id int, html string"), model).collect()}
    assert got[98] == got[99] == [] and sum(bool(v) for v in got.values()) >= 39
    page = "<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T &amp; U</h1><p>One  two.<p>Three<br>four.</article><div class=comments><p>Nice!</p></div><footer>x</footer>"
    assert model.prepared().extract(page) == ["T & U", "One two.", "Three four."]


def test_omitted_end_tags_leave_the_text():
    def text(page):
        return "|".join(" ".join(own.split()) for own in op6.Page(page).own if own)

    assert text("<form><select><option>A<option>B</select></form><p>One.") == "One."
    assert text("<form><select><optgroup><option>A<optgroup><option>B</select></form><p>One.") == "One."
    assert text("<div><select><option>A</div><p>One.") == "One."
    assert text("<select><option>A<select><p>One.") == "One."
    assert text("<option>A<option>B<p>One.") == "One."
    assert text("<html><head><meta charset=x><title>T</title><script>x</script><p>One.<p>Two.") == "One.|Two."
    assert text("<head><title>T</title> One.") == "One."
    assert text("<head><!-- c --><link href=x></head><p>One.") == "One."
    assert text("<div><object><div>a</div>b</object>One.</div><svg><g><path d=x></g><text>c</text></svg><p>Two.") == "One.|Two."
    assert text("<datalist><option>A<option>B</datalist><p>One.") == "One."


def test_marginals_match_enumeration():
    model = op6.trained(60).prepared()
    page = op6.Page("<div><p>a b.</p><ul><li>c</li></ul></div>")
    n = len(page.blocks)
    total, ones = 0.0, np.zeros(n)
    for mask in range(2**n):
        y = [mask >> i & 1 for i in range(n)]
        s = sum(sum(model.weights[k] * v for k, v in page.active[i]) for i in range(n) if y[i]) + sum(model.edges[page.kind[i], y[page.parent[i]], y[i]] for i in range(1, n))
        total += np.exp(s)
        ones += np.exp(s) * np.array(y)
    assert model.marginals(page) == pytest.approx(list(ones / total))


def test_segments_match_brute_force():
    model = op1.Model({"bad": 2.0, "vile": 1.0}, neutral=-0.5).prepared()
    r = random.Random(6)
    for _ in range(50):
        tokens = [r.choice(["bad", "vile", "a", "b", "c", "d"]) for _ in range(r.randrange(1, 40))]
        scores = [model.weights.get(t, 0) or -0.5 for t in tokens]
        found = model.segments(tokens)
        assert max((s for *_, s in found), default=0) == pytest.approx(max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))]))
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
        assert all(s == pytest.approx(sum(scores[a:b])) for a, b, s in found)


def test_classifiers(spark):
    sf = "/root/testdata/sf0.1"
    labels, documents = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    got = op1.op1_toxicity(spark, sf).join(labels, "doc_id").where("held_out").agg(F.avg(((F.col("predicted") == F.col("toxic"))).cast("double"))).first()[0]
    assert got > 0.95
    out = op10.op10_language_id(spark, sf).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.98


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "the word", None), (None, "le mot", "fr")], "doc_id long, text string, lang string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.toxicity.score < 1e-9 for r in op1.toxicity(docs, op1.fit(docs, empty)).collect())
    out = {r.doc_id: r.language.lang_pred for r in op10.language_id(docs, op10.train(docs)).collect()}
    assert out[1] == out[2] == out[3] == "und" and len(out) == 5


def test_numbers_that_are_no_letters():
    model = op10.ByteCnn(["en", "fr"])
    assert all(model.predict(t) == (op10.UNKNOWN, 0.0) for t in ("½ ² ½", "Ⅷ", "", "12", None)) and model.predict("½ a")[0] != op10.UNKNOWN
    texts = ["the word ½", None, "²", "mot " * 9000, "a"]
    one, many = [model.predict(t) for t in texts], model.predict_all(texts)
    for told in (many, model.ready().predict_all(texts)):
        for (a, x), (b, y) in zip(one, told, strict=True):
            assert a == b and x == pytest.approx(y, abs=1e-5)


def test_scores_beyond_64_bits(spark):
    big = 2.0**40
    rows = [(0, [big, big]), (1, [big, big]), (2, [-big, -big]), (3, [1.0, -0.5]), (4, [2.0**1020, 0.0]), (None, [big, big])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.vec_id, x.score) for x in op2.exact_top_k(df.where("vec_id = 0"), df).orderBy("rank").collect()]
    assert got == [(1, (1 << 63) - 1), (3, 256 * 2**39 * 256), (2, -(1 << 63))]


def test_carried_columns_are_the_rows_own(spark):
    rows = spark.createDataFrame([(1, "first", "a"), (1, "second", "b"), (None, "third", None)], "doc_id long, text string, note string")
    assert {(r.doc_id, r.note) for r in op4.simhash_near_dedup(rows, carry=["note"]).collect()} == {(1, "a"), (1, "b"), (None, None)}


def test_answers_take_free_names(spark):
    rows = spark.createDataFrame([(1, "the word", 5, 6, 7, "<p>x")], "doc_id long, text string, toxicity int, language int, blocks int, html string")
    out = op6.extract_text(op10.language_id(op1.toxicity(rows, op1.Model(), into="a"), op10.ByteCnn(["en"]), into="b"), op6.TreeModel(), into="c").first()
    assert (out.toxicity, out.language, out.blocks) == (5, 6, 7)


def test_new_letters_are_split_as_by_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library, own = tokenizers.Tokenizer.from_file(op5.default_path()), op5.load(op5.default_path())
    for c in [0x1C89, 0xA7CB, 0xA7CE, 0xA7DC, 0x10D41, 0x10D50, 0x11390, 0x13460, 0x16D40, 0x16EA0, 0x1E5D0, 0x323B0, 0x18E00]:
        for text in (f"ab{chr(c)}cd", f"!{chr(c)}!"):
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_lowest_hashes_are_a_bounded_sample(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("at"))
    got = common.lowest(rows, "at", 100, F.col("id") % 5 != 0)
    want = sorted((r.at, r.id) for r in rows.collect() if r.id % 5)[:100]
    assert sorted((r.at, r.id) for r in got.collect()) == want and common.lowest(rows.limit(0), "at", 5, F.lit(True)).count() == 0


def test_links_between_many_vectors(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(900, 64))
    near = base[r.integers(0, 900, 2500)] + r.normal(size=(2500, 64)) * 0.25
    x = np.concatenate([base, near, base[:50]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for spread, least in ((None, 1.0), (op7.SPREAD, 0.98)):
        got = {v.vec_id: v.n_links for v in op7.embedding_near_dedup(df, spread=spread).collect()}
        links = np.array([got[i] for i in range(len(x))])
        assert (links <= want).all() and links.sum() >= least * want.sum() > 0


def test_bounds_of_shared_shingles():
    r = np.random.default_rng(1)
    for n, m, k in [(0, 3, 0), (5, 9, 2), (300, 700, 250), (9000, 5000, 3000)]:
        pool = np.unique(r.integers(0, 1 << 63, n + m, dtype=np.uint64))
        a, b = pool[:n], pool[max(0, n - k) : max(0, n - k) + m]
        shared = len(np.intersect1d(a, b))
        assert shared <= near_documents_module.most_shared(near_documents_module.buckets(a), near_documents_module.buckets(b), len(a), len(b)) <= min(len(a), len(b))
        differ = int(np.unpackbits((near_documents_module.parities(a) ^ near_documents_module.parities(b)).view(np.uint8)).sum())
        assert differ <= len(a) + len(b) - 2 * shared and differ % 2 == (len(a) + len(b)) % 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, html string")
    model = op10.train(empty.withColumn("lang", F.lit("en")))
    for df in (op8.substring_dedup(empty), op9.suffix_array_dedup(empty), op4.simhash_near_dedup(empty), op5.bpe_round_trip(empty), op2.exact_top_k(vectors, vectors), op7.embedding_near_dedup(vectors), op6.extract_text(pages, op6.trained(10)), op10.language_id(empty, model), near_documents(empty)):
        assert df.count() == 0


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    out = pipeline.run(spark, SF).toPandas()
    ids = {r.doc_id for r in documents.collect()}
    assert set(out.doc_id) <= ids and len(set(out.doc_id)) > 0.7 * len(ids)
    assert out.groupby("sequence_id").length.sum().max() <= 4096
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]


def test_pipeline_stages_carry_all_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    base = "".join(r.choice("abcdef ") for _ in range(150))
    rows = [(1, "x" + base, "en", None, 9, 4, "k1"), (2, "y" + base, None, "s", None, None, "k2"), (2, "y" + base, None, "s", None, None, "k3"), (3, None, "en", "s", 0, 1, None), (None, "", "fr", "s", 0, 1, "k5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxicity int, kept string").withColumn("language", F.lit(3)).withColumn("a b", F.struct(F.lit(1).alias("x y")))
    for name, stage in pipeline.STAGES[:-1]:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, SF)
            assert out.columns == docs.columns and out.schema == docs.schema, name
            got = {x.kept: (x.toxicity, x.language) for x in out.collect()}
            assert all(got[x[-1]] == (x[-2], 3) for x in rows if x[-1] in got), name
    cut = {x.kept: x for x in pipeline.cut_repeats(spark, docs, SF).collect()}
    assert cut["k1"].text == "x" + base and cut["k2"].text == cut["k3"].text == "y" and cut["k2"].n_chars == 1 and cut["k2"]["a b"]["x y"] == 1
    assert {x.kept for x in pipeline.drop_near_copies(spark, docs, SF).collect()} == {"k1", "k5"}


def test_pipeline_keeps_replacement_characters(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(9)
    base = "".join(r.choice("abcdef ") for _ in range(150))
    rows = [(1, "a � stays", "en", "s", 9), (2, "é" + base, "en", "s", 9), (3, "� è" + base, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x.text for x in pipeline.cut_repeats(spark, docs, SF).collect()}
    assert got[1] == "a � stays" and got[2] == "é" + base and got[3].startswith("� ") and base not in got[3]
    docs = spark.createDataFrame([(1, "é" + base, "en", "s", 9), (2, "� \u0229" + base, "en", "s", 9)], docs.schema)  # share the second byte
    assert pipeline.cut_repeats(spark, docs, SF).where("doc_id = 2").first().text == "� "


def test_few_rows_that_qualify_are_all_sampled(spark):
    rows = spark.range(100_000).select("id", F.xxhash64("id").alias("at"))
    assert common.lowest(rows, "at", 2000, F.col("id") % 3000 == 7).count() == 34
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1500 == 1, F.lit("some words of one tongue")).otherwise(F.lit("12 34")).alias("text"), F.lit("en").alias("lang"))
    assert op10.train(docs).classes == ["en"]


@pytest.mark.parametrize("inner", [2, 3, 4, 6])
def test_links_of_vectors_that_keep_to_few_directions(spark, inner):
    r = np.random.default_rng(inner)
    x = r.normal(size=(3000, inner)) @ r.normal(size=(inner, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum((unit[s : s + 500] @ unit.T >= 0.95).sum() for s in range(0, len(x), 500)) - len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = op7.embedding_near_dedup(df).agg(F.sum("n_links")).first()[0]
    assert 0.99 * want <= got <= want


def test_links_of_vectors_beyond_the_range_of_squares(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [2e200, 2e200]), (4, [3.0, 3.0]), (5, [1e-200, 1e-200]), (6, [5e-324, 5e-324]), (7, [1e200, -1e200]), (8, None), (9, [0.0, 0.0]), (None, None)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in op7.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (5, 1) for i in range(1, 7)) and got[7] == (0, 7) and got[8] == (0, 8) and got[9] == (0, 9) and got[None] == (0, None)


_SENTENCE = " ".join(["The quick brown fox jumps over the lazy dog near the river bank while the sun goes down slowly"] * 2)


@pytest.mark.parametrize(
    ("opening", "closing", "tag", "ends"),
    [
        ("<article data-class='sidebar ad'><h1>Title</h1>", "</article>", "p", "."),
        ("<article data-id='comment-12'><h1>Title</h1>", "</article>", "p", "."),
        ("<div data-role='footer-content'><h1>Title</h1>", "</div>", "p", "."),
        ("<article class='story more'><h1>Title</h1>", "</article>", "p", "."),
        ("<article class='post tags-politics archive'><h1>Title</h1>", "</article>", "p", "."),
        ("<div>", "</div>", "div", "."),
        ("<div>", "</div>", "p", ""),
        ("<div>", "</div>", "p", ". [1]"),
        ("<article><h1>Title</h1>", "<aside class='related'><a href='/x'>See also</a></aside></article>", "p", ""),
        ("<article><h1>Title</h1>", "<form><input name=q><button>Go</button></form></article>", "p", ""),
    ],
)
def test_articles_in_unusual_containers(opening, closing, tag, ends):
    texts = [f"{_SENTENCE} number {i}{ends}" for i in range(4)]
    inner = "".join(f"<{tag}>{t}</{tag}>" for t in texts)
    before = "<header><a href='/'>Home</a></header><nav class='menu'><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav>"
    page = f"<html><head><title>t</title></head><body>{before}{opening}{inner}{closing}<footer class='footer'>&copy; Example 2020</footer></body></html>"
    assert _trained().extract(page) == ["Title"] * ("<h1>" in opening) + texts


def _trained():
    if not _held:
        _held.append(op6.trained().prepared())
    return _held[0]


_held: list = []


def test_names_within_names_and_values_are_no_attributes():
    names = {op6.FEATURES[i] for i in op6._attribute_features(" data-class='ad' title=\"class=sidebar\" aria-hidden=true Class=comment id='x main'")}
    assert names == {"hidden", "word comment", "word for"}


def test_links_of_fingerprints_are_never_broadcast(spark, docs):
    """The driver builds broadcasts, so no join of op4 may make one of what grows with the input, however small it looks."""
    from ragscore.llm import op4

    plan = op4.simhash_near_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    prints = spark.createDataFrame([(1,), (3,), (64,)], "fp long")
    assert "Broadcast" not in op4.near_fingerprints(prints)._jdf.queryExecution().executedPlan().toString()
