"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

from ragscore.operators.search import ENGLISH
from ragscore.oracle_text import common_subsequence, murmur3, stemmed, tokens_13a

_W = "list_filter(regexp_split_to_array(coalesce({0}, ''), '[\\s\\x{{85}}\\x{{A0}}]+'), lambda w: w <> '')"
_TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _words(x: str) -> str:
    return _W.format(x)


def _terms(x: str) -> str:
    return _TERMS.format(x)


def _grams(x: str, n: int) -> str:
    return x if n == 1 else f"(CASE WHEN len({x}) >= {n} THEN list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n - 1}], ' ')) ELSE [] END)"


GOLD = "gold AS MATERIALIZED (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
RUN = f"""
bt AS MATERIALIZED (SELECT item_id, unnest(list_distinct({_terms('text')})) AS term FROM benchmark),
dt AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({_terms('text')})) AS term FROM documents),
bn AS (SELECT item_id, count(*) AS n FROM bt GROUP BY 1), dn AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY 1),
sh AS (SELECT item_id, doc_id, count(*) AS s FROM bt JOIN dt USING (term) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, (1000 * s) // (bn.n + dn.n - s) AS score FROM sh JOIN bn USING (item_id) JOIN dn USING (doc_id)),
run AS MATERIALIZED (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS pos, doc_id, score FROM sc QUALIFY pos <= 10)"""
QA = """
tl AS (SELECT conv_id, turn, role, text, lead(role, 1) OVER w AS r1, lead(text, 1) OVER w AS t1, lead(role, 3) OVER w AS r3, lead(text, 3) OVER w AS t3
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qa AS MATERIALIZED (SELECT conv_id * 100 + turn AS sample_id, conv_id, turn, text AS query, t1 AS response, CASE WHEN r3 = 'assistant' THEN t3 END AS reference
  FROM tl WHERE role = 'user' AND r1 = 'assistant')"""
LAB = """
qb AS (SELECT *, first_value(sample_id) OVER (PARTITION BY conv_id ORDER BY turn) AS base FROM qa),
lab AS MATERIALIZED (SELECT * EXCLUDE (base), CASE WHEN sample_id <> base THEN base END AS variant_of,
  CASE WHEN sample_id <> base THEN (['paraphrase', 'typo', 'counterfactual'])[conv_id % 3 + 1] WHEN conv_id % 5 = 0 THEN 'unanswerable' END AS scenario FROM qb)"""


def _scores(k: int) -> str:
    return f"""
h{k} AS (SELECT r.item_id, r.pos, r.doc_id, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM run r LEFT JOIN gold g ON g.item_id = r.item_id AND g.doc_id = r.doc_id WHERE r.pos <= {k}),
hr{k} AS (SELECT *, sum(hit) OVER (PARTITION BY item_id ORDER BY pos) AS running FROM h{k}),
p{k} AS (SELECT item_id, count(*) AS n, sum(hit) AS hits, count(DISTINCT CASE WHEN hit = 1 THEN doc_id END) AS found, min(CASE WHEN hit = 1 THEN pos END) AS first_hit,
  sum(CASE WHEN hit = 1 THEN running / pos ELSE 0 END) AS ap, sum(CASE WHEN hit = 1 THEN 1 / log2(pos + 1) ELSE 0 END) AS dcg FROM hr{k} GROUP BY 1),
gs{k} AS (SELECT item_id, count(*) AS g FROM gold GROUP BY 1),
s{k} AS (SELECT gs{k}.item_id, coalesce(found / g, 0) AS recall, coalesce(hits / n, 0) AS precision, coalesce(CAST(hits > 0 AS DOUBLE), 0) AS hit_rate, coalesce(1.0 / first_hit, 0) AS mrr,
  coalesce(ap / g, 0) AS map, coalesce(dcg / list_sum(list_transform(range(1, least(g, {k}) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg FROM gs{k} LEFT JOIN p{k} USING (item_id))"""


def _retrieval(m: str) -> str:
    one = lambda k: f"SELECT '{m}@{k}' AS metric, round(coalesce(avg({m}), 0), 6) AS value, count(*) AS num_samples FROM s{k}"
    return f"WITH {GOLD}, {RUN}, {_scores(5)}, {_scores(10)} {one(5)} UNION ALL {one(10)}"


def _mean(name: str, scores: str, source: str = "sc_") -> str:
    return f"{scores} SELECT '{name}' AS metric, round(coalesce(avg(score), 0), 6) AS value, count(score) AS num_samples FROM {source}"


def _norm(x: str) -> str:
    return f"list_filter({_words(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")}, lambda w: w NOT IN ('a', 'an', 'the'))"


def _rouge(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _overlap(left: str, right: str, rows: str, key: str = "sample_id") -> str:
    """Common tables: t_ with both token lists, ov_ with their sizes and the multiset overlap."""
    return f"""
t_ AS MATERIALIZED (SELECT {key}, {left} AS l, {right} AS r FROM {rows}),
lc_ AS (SELECT {key}, t, count(*) AS c FROM (SELECT {key}, unnest(l) AS t FROM t_) GROUP BY ALL),
rc_ AS (SELECT {key}, t, count(*) AS c FROM (SELECT {key}, unnest(r) AS t FROM t_) GROUP BY ALL),
sh_ AS (SELECT {key}, sum(least(lc_.c, rc_.c)) AS shared FROM lc_ JOIN rc_ USING ({key}, t) GROUP BY 1),
ov_ AS MATERIALIZED (SELECT t_.{key}, len(l) AS nl, len(r) AS nr, coalesce(shared, 0) AS shared FROM t_ LEFT JOIN sh_ USING ({key}))"""


_F = "CASE WHEN shared > 0 THEN 2.0 * shared / (nl + nr) ELSE 0 END"
_REF = "(SELECT * FROM qa WHERE reference IS NOT NULL AND reference <> '')"
_F1 = f"sc_ AS (SELECT sample_id, CASE WHEN nl = 0 AND nr = 0 THEN 1.0 ELSE {_F} END AS score FROM ov_)"


def _hashed(pairs: str, murmur: bool = False) -> str:
    """sc_: cosine of hashed bags of words of the columns a and b of the pairs."""
    bucket = "b" if murmur else "CAST(('0x' || md5(t)[1:8]) AS BIGINT) % 4096"
    terms = lambda c: f"SELECT sample_id, unnest({_terms(f"coalesce({c}, '')")}) AS t FROM pr_"
    side = lambda c: f"(SELECT sample_id, {bucket} AS b, count(*) AS c FROM ({terms(c)}){' JOIN mm_ USING (t)' if murmur else ''} GROUP BY ALL)"
    told = f"{murmur3(f'{terms("a")} UNION ALL {terms("b")}')}," if murmur else ""
    return f"""pr_ AS MATERIALIZED ({pairs}), {told} va AS {side('a')}, vb AS {side('b')},
na AS (SELECT sample_id, sum(c * c) AS n FROM va GROUP BY 1), nb AS (SELECT sample_id, sum(c * c) AS n FROM vb GROUP BY 1),
dot AS (SELECT sample_id, sum(va.c * vb.c) AS d FROM va JOIN vb USING (sample_id, b) GROUP BY 1),
sc_ AS (SELECT sample_id, coalesce(d / sqrt(CAST(na.n AS DOUBLE) * nb.n), 0) AS score FROM pr_ LEFT JOIN na USING (sample_id) LEFT JOIN nb USING (sample_id) LEFT JOIN dot USING (sample_id))"""


CHUNKS = f"""
cw AS MATERIALIZED (SELECT doc_id, {_words('text')} AS w FROM documents),
ci AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 224.0) AS BIGINT))) AS i FROM cw WHERE len(w) > 0),
chunks AS MATERIALIZED (SELECT doc_id || '_chunk_' || i AS chunk_id, doc_id AS parent_doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(w[i * 224 + 1:i * 224 + 256], ' ') AS text FROM ci)"""
ANCHORS = f"""
ap AS (SELECT chunk_id, string_split(text, '.') AS p FROM chunks),
ae AS (SELECT chunk_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS i FROM ap),
ao AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char, trim(piece) AS sentence FROM ae),
asx AS (SELECT *, {_words('sentence')} AS w FROM ao WHERE trim(piece) <> ''),
asc_ AS (SELECT *, CASE WHEN len(w) BETWEEN 10 AND 50 THEN 1.0 ELSE 0 END + CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) > 0 THEN 0.5 ELSE 0 END
  + CASE WHEN regexp_matches(sentence, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉]') THEN 0.5 ELSE 0 END AS score FROM asx),
anchors AS MATERIALIZED (SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, i) AS INTEGER) AS pos, sentence, CAST(start_char AS BIGINT) AS start_char,
  CAST(start_char + length(sentence) AS BIGINT) AS end_char, CAST(score AS DOUBLE) AS score, w FROM asc_ WHERE score > 0 QUALIFY pos <= 3)"""
SPANS = r"""
sp1 AS (SELECT *, w[2:] AS tail FROM anchors),
sp2 AS (SELECT *, list_transform(tail, lambda x: regexp_matches(x, '^\p{Lu}')) AS big FROM sp1),
sp3 AS (SELECT *, coalesce(list_position(big, true), 0) AS f FROM sp2),
sp4 AS (SELECT *, coalesce(list_position(big[f:], false), 0) AS s FROM sp3),
spans AS MATERIALIZED (SELECT chunk_id, pos, sentence, trim(CASE WHEN f > 0 THEN array_to_string(CASE WHEN s > 0 THEN tail[f:f + s - 2] ELSE tail[f:] END, ' ') ELSE w[-1] END, '.,!?;:') AS span FROM sp4)"""
ENTITIES = f"""
ew AS (SELECT chunk_id, {_words('text')} AS w FROM chunks),
ex AS (SELECT chunk_id, trim(unnest(w), '.,!?;:()[]"''') AS w, unnest(range(1, len(w) + 1)) AS i FROM ew),
eb AS (SELECT *, i - row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS isl FROM ex WHERE regexp_matches(w, '^\\p{{Lu}}')),
es AS (SELECT *, max(CASE WHEN length(w) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id, isl ORDER BY i) AS on_ FROM eb),
er AS (SELECT chunk_id, isl, string_agg(w, ' ' ORDER BY i) AS entity FROM es WHERE on_ = 1 GROUP BY ALL),
entities AS MATERIALIZED (SELECT DISTINCT chunk_id, entity FROM er WHERE lower(entity) NOT IN ('the', 'a', 'an', 'this', 'that', 'these', 'those', 'it', 'he', 'she', 'they', 'we', 'you', 'in', 'on'))"""
EDGES = "edges AS MATERIALIZED (SELECT a.chunk_id AS src, b.chunk_id AS dst, count(*) AS shared FROM entities a JOIN entities b ON a.entity = b.entity AND a.chunk_id < b.chunk_id GROUP BY 1, 2 HAVING count(*) >= 2)"
PAIRS = """bo AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), pk AS (SELECT src, min_by(dst, md5('pairs:' || src || ':' || dst)) AS dst FROM bo GROUP BY 1),
pairs AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM pk)"""
UNIT = "un AS MATERIALIZED (SELECT vec_id, v, list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-12)) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings))"
KNN = f"""{UNIT}, ks AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.u, c.u), 9) AS score FROM un q JOIN un c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
knn AS MATERIALIZED (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS pos, vec_id, score FROM ks QUALIFY pos <= 5)"""


def _bleu_part(n: int) -> str:
    rows = "(SELECT * FROM qa WHERE reference IS NOT NULL)"
    left, right = _grams(_words("response"), n), _grams(_words("reference"), n)
    return f"(WITH {_overlap(left, right, rows)} SELECT {n} AS n, CAST(sum(shared) AS BIGINT) AS matches, CAST(sum(nl) AS BIGINT) AS total FROM ov_)"


def _evidence(n: int) -> str:
    return _mean(
        f"evidence_overlap_n{n}",
        f"""WITH {RUN}, ev AS (SELECT r.item_id, string_agg(d.text, ' ' ORDER BY pos) AS e FROM run r JOIN documents d USING (doc_id) WHERE pos <= 5 GROUP BY 1),
pq AS (SELECT b.item_id, b.text AS response, e FROM benchmark b JOIN ev USING (item_id)), {_overlap(_grams(_words('response'), n), _grams(_words('e'), n), 'pq', 'item_id')},
sc_ AS (SELECT item_id, CASE WHEN nl > 0 THEN shared / nl ELSE 0 END AS score FROM ov_)""",
    )


def _distinct(n: int) -> str:
    return f"WITH {QA}, g AS (SELECT unnest({_grams(_words('response'), n)}) AS g FROM qa) SELECT 'distinct_{n}' AS metric, round(count(DISTINCT g) / count(*), 6) AS value, (SELECT count(*) FROM qa) AS num_samples FROM g"


def _rouge_n(n: int) -> str:
    return _mean(f"rouge{n}_nostem", f"WITH {QA}, {_overlap(_grams(_rouge("coalesce(response, '')"), n), _grams(_rouge('reference'), n), _REF)}, sc_ AS (SELECT {_F} AS score FROM ov_)")


_QUESTION = "'Which detail does the passage state?'"
SQL: dict[str, str] = {f"{m}_at_k": _retrieval(m) for m in ("recall", "precision", "hit_rate", "mrr", "map", "ndcg")} | {
    "retrieval_per_sample": f"WITH {GOLD}, {RUN}, {_scores(5)} SELECT item_id, {', '.join(f'round({m}, 6) AS {m}' for m in ('recall', 'precision', 'hit_rate', 'mrr', 'map', 'ndcg'))} FROM s5",
    "exact_match": _mean("exact_match", f"WITH {QA}, sc_ AS (SELECT CAST(array_to_string({_norm('response')}, ' ') = array_to_string({_norm('reference')}, ' ') AS DOUBLE) AS score FROM {_REF})"),
    "token_f1": _mean("token_f1", f"WITH {QA}, {_overlap(_norm("coalesce(response, '')"), _norm('reference'), _REF)}, {_F1}"),
    "token_f1_raw": _mean("token_f1_raw", f"WITH {QA}, {_overlap(_words('response'), _words('reference'), _REF)}, {_F1}"),
    "rouge1_nostem": _rouge_n(1),
    "rouge2_nostem": _rouge_n(2),
    "embedding_similarity_md5": _mean("embedding_similarity_md5", f"WITH {QA}, {_hashed("SELECT sample_id, response AS a, reference AS b FROM qa WHERE reference <> ''")}"),
    "bleu_stats_ws": f"WITH {QA} {' UNION ALL '.join(_bleu_part(n) for n in range(1, 5))}",
    "precision_with_skipped": f"WITH {GOLD.replace('contains(d.text, b.text)', 'contains(d.text, b.text) AND b.item_id % 3 <> 0')}, {RUN}, {_scores(5)} SELECT 'precision@5' AS metric, round(coalesce(avg(precision), 0), 6) AS value, count(*) AS num_samples, (SELECT count(*) FROM benchmark) - count(*) AS num_skipped FROM s5",
    "token_f1_with_skipped": f"WITH {QA}, {_overlap(_norm("coalesce(response, '')"), _norm('reference'), _REF)}, {_F1} SELECT 'token_f1' AS metric, round(coalesce(avg(score), 0), 6) AS value, count(score) AS num_samples, (SELECT count(*) FROM qa) - count(score) AS num_skipped FROM sc_",
    "evidence_overlap_relevant": _mean(
        "evidence_overlap_n2",
        f"""WITH {GOLD}, ev AS (SELECT g.item_id, string_agg(d.text, ' ' ORDER BY doc_id) AS e FROM gold g JOIN documents d USING (doc_id) GROUP BY 1),
pq AS (SELECT b.item_id, b.text AS response, e FROM benchmark b JOIN ev USING (item_id)), {_overlap(_grams(_words('response'), 2), _grams(_words('e'), 2), 'pq', 'item_id')},
sc_ AS (SELECT item_id, CASE WHEN nl > 0 THEN shared / nl ELSE 0 END AS score FROM ov_)""",
    ),
    "llm_entities_mock": f"""WITH {CHUNKS}, {ENTITIES}, asked AS (SELECT chunk_id, text, md5('Name at most five people, organisations or places of the text, parted by commas, and nothing else.' || chr(10) || 'TEXT:' || text) AS m FROM chunks),
listed AS (SELECT DISTINCT chunk_id, trim(unnest(string_split(array_to_string(w[1:2], ', '), ','))) AS entity FROM (SELECT chunk_id, {_words('text')} AS w FROM asked WHERE m[1] < '8')),
named AS (SELECT * FROM listed WHERE entity <> '')
SELECT * FROM named UNION ALL SELECT * FROM entities WHERE chunk_id NOT IN (SELECT chunk_id FROM named)""",
    "filtered_tasks_mock": f"""WITH {CHUNKS}, {ANCHORS}, {SPANS} SELECT 'single_hop:' || chunk_id || ':' || pos AS sample_id, span AS answer FROM spans JOIN chunks USING (chunk_id)
WHERE len({_words('span')}) BETWEEN 1 AND 64 AND contains(lower(text), lower(span)) AND length(span) >= 8""",
    "evidence_overlap_n1": _evidence(1),
    "evidence_overlap_n2": _evidence(2),
    "distinct_1": _distinct(1),
    "distinct_2": _distinct(2),
    "mean_latency": "SELECT 'mean_latency[' || event_type || ']' AS metric, round(avg(value), 6) AS value, count(*) AS num_samples FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "quantile_latency": "SELECT 'latency_q0.95[' || event_type || ']' AS metric, round(quantile_disc(value, 0.95), 6) AS value, count(*) AS num_samples FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "dense_knn": f"WITH {KNN} SELECT * FROM knn",
    "intra_list_diversity": _mean("intra_list_diversity@5", f"""WITH {KNN}, pr AS (SELECT a.query_id, list_inner_product(x.u, y.u) AS c FROM knn a JOIN knn b ON a.query_id = b.query_id AND a.pos < b.pos JOIN un x ON x.vec_id = a.vec_id JOIN un y ON y.vec_id = b.vec_id),
sc_ AS (SELECT query_id, 1 - avg(c) AS score FROM pr GROUP BY 1)"""),
    "tfidf_topk": f"""WITH dc AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY ALL),
qc AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
idf AS MATERIALIZED (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM dc GROUP BY 1),
dw AS MATERIALIZED (SELECT doc_id, term, tf * idf AS w FROM dc JOIN idf USING (term)), qw AS MATERIALIZED (SELECT item_id, term, tf * idf AS w FROM qc JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
dot AS (SELECT item_id, doc_id, sum(dw.w * qw.w) AS d FROM dw JOIN qw USING (term) GROUP BY ALL),
al AS (SELECT b.item_id, d.doc_id, coalesce(round(dot.d / (dn.n * qn.n), 9), 0.0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN dot ON dot.item_id = b.item_id AND dot.doc_id = d.doc_id LEFT JOIN dn ON dn.doc_id = d.doc_id LEFT JOIN qn ON qn.item_id = b.item_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS pos, doc_id, score FROM al QUALIFY pos <= 5""",
    "noise_robustness_token_f1": f"""WITH {QA}, {LAB}, {_overlap(_norm("coalesce(response, '')"), _norm('reference'), "(SELECT * FROM lab WHERE reference <> '')")}, {_F1},
j AS (SELECT lab.*, score FROM lab JOIN sc_ USING (sample_id)),
a AS (SELECT coalesce(avg(score) FILTER (variant_of IS NULL), 0) AS b, coalesce(avg(score) FILTER (scenario IN ('paraphrase', 'typo')), 0) AS n, count(*) FILTER (variant_of IS NULL) AS bs, count(*) FILTER (scenario IN ('paraphrase', 'typo')) AS ns FROM j)
SELECT 'noise_robustness[token_f1]' AS metric, round(CASE WHEN b > 1e-8 THEN n / b ELSE 0 END, 6) AS value, round(b, 6) AS base_score, round(n, 6) AS noise_score, bs AS base_samples, ns AS noise_samples FROM a""",
    "negative_rejection_rate": f"WITH {QA}, {LAB} SELECT 'negative_rejection_rate' AS metric, round(coalesce(avg(CAST(contains(lower(response), 'tion') OR contains(lower(response), 'eine') AS DOUBLE)), 0), 6) AS value, count(*) AS num_samples FROM lab WHERE scenario = 'unanswerable'",
    "counterfactual_consistency": f"""WITH {QA}, {LAB}, {_hashed("SELECT v.sample_id, b.response AS a, v.response AS b FROM lab v JOIN lab b ON v.variant_of = b.sample_id WHERE v.scenario = 'counterfactual'")}
SELECT 'counterfactual_consistency' AS metric, round(coalesce(avg(score), 0), 6) AS value, count(*) AS num_samples FROM sc_""",
    "slice_grouping_sets": f"""WITH {QA}, {LAB}, {_overlap(_norm("coalesce(response, '')"), _norm('reference'), "(SELECT * FROM lab WHERE reference <> '')")}, {_F1},
j AS (SELECT coalesce(scenario, 'plain') AS slice, score FROM lab JOIN sc_ USING (sample_id))
SELECT slice, round(avg(score), 6) AS value, count(*) AS num_samples FROM j GROUP BY 1 UNION ALL SELECT 'total', round(avg(score), 6), count(*) FROM j""",
    "validate_coverage": f"WITH {QA} SELECT count(*) AS num_samples, count(query) AS query, count(response) AS response, count(reference) AS reference FROM qa",
    "latency_by_window": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS key, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY ALL",
    "chunk_documents": f"WITH {CHUNKS} SELECT * FROM chunks",
    "extract_anchors": f"WITH {CHUNKS}, {ANCHORS} SELECT * EXCLUDE (w) FROM anchors",
    "choose_answer_span": f"WITH {CHUNKS}, {ANCHORS}, {SPANS} SELECT chunk_id, pos, span FROM spans",
    "single_hop_tasks_mock": f"WITH {CHUNKS}, {ANCHORS}, {SPANS} SELECT 'single_hop:' || chunk_id || ':' || pos AS sample_id, chunk_id, CASE WHEN contains(lower(span || sentence), 'multi-hop') THEN 'Question: How do both facts relate?' ELSE {_QUESTION} END AS query, span AS answer FROM spans WHERE len({_words('span')}) BETWEEN 1 AND 64",
    "find_relevant_docs": f"WITH {CHUNKS}, {ANCHORS}, {SPANS}, ds AS (SELECT DISTINCT span FROM spans WHERE span <> '') SELECT span, count(*) AS n_chunks FROM ds JOIN chunks ON contains(text, span) GROUP BY 1",
    "answer_presence_filter": f"WITH {CHUNKS}, {ANCHORS}, {SPANS} SELECT chunk_id, pos, span FROM spans JOIN chunks USING (chunk_id) WHERE contains(lower(text), lower(span))",
    "question_length_filter": f"WITH {QA} SELECT sample_id FROM qa WHERE len({_words('query')}) BETWEEN 5 AND 50",
    "extract_entities": f"WITH {CHUNKS}, {ENTITIES} SELECT * FROM entities",
    "entity_graph": f"WITH {CHUNKS}, {ENTITIES}, {EDGES} SELECT * FROM edges",
    "entity_degree": f"WITH {CHUNKS}, {ENTITIES}, {EDGES} SELECT chunk_id, count(*) AS degree FROM (SELECT src AS chunk_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1",
    "sample_doc_pairs_md5": f"WITH {CHUNKS}, {ENTITIES}, {EDGES}, {PAIRS} SELECT * FROM pairs",
    "multi_hop_tasks_mock": f"""WITH {CHUNKS}, {ANCHORS}, {ENTITIES}, {EDGES}, {PAIRS}, oa AS (SELECT DISTINCT chunk_id FROM anchors)
SELECT 'multi_hop:' || a || ':' || b AS sample_id, a, b, 'How do both facts relate?' AS query, 'They share a subject.' AS answer FROM pairs WHERE a IN (SELECT chunk_id FROM oa) AND b IN (SELECT chunk_id FROM oa)""",
    "paraphrase_fanout_mock": f"WITH {QA} SELECT sample_id || ':paraphrase:' || i AS sample_id, sample_id AS variant_of, 'paraphrase' AS scenario, CASE WHEN contains(lower(query), 'multi-hop') THEN 'Question: How do both facts relate?' WHEN contains(lower(query), 'write a question') THEN {_QUESTION} ELSE 'Put differently, which detail is stated?' END AS query FROM qa, range(1, 3) t(i)",
    "closed_world_corpus": f"WITH {GOLD} SELECT doc_id, min(item_id) * 1000000000 + doc_id AS ordinal, md5(any_value(text)) AS text_md5 FROM gold JOIN documents USING (doc_id) GROUP BY doc_id",
    "results_report": "SELECT '| LATENCY | mean_latency[' || event_type || '] | ' || printf('%.4f', round(avg(value), 6)) || ' |' AS line FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "leaderboard_index": """WITH p AS (SELECT event_type, CAST(ts AS DATE) AS d, round(avg(CASE WHEN value > 10 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END), 6) AS share, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2), r AS (SELECT *, day(d) AS n FROM p)
SELECT event_type || '_' || d || '.json' AS filename, event_type AS system_name, d || 'T00:00:00' AS timestamp, 'events' AS dataset, share AS recall, 5 AS recall_k, round(share / 2, 6) AS token_f1,
CASE WHEN n % 3 = 0 THEN share WHEN n % 3 = 1 THEN round(share / 4, 6) END AS bertscore, CASE WHEN n % 4 = 0 THEN share END AS llm_quality, CASE WHEN n % 5 = 0 THEN mean WHEN n % 5 = 1 THEN round(mean / 2, 6) END AS latency FROM r""",
}

_STRIP = r"regexp_replace({0}, '^[\s\x{{85}}\x{{A0}}]+|[\s\x{{85}}\x{{A0}}]+$', '', 'g')"
_HUNDREDTHS = "CAST('0x' || md5({0})[1:4] AS INTEGER) % 100 / 100"
_FOUND = f"""{RUN}, ev AS MATERIALIZED (SELECT item_id, list(d.text ORDER BY pos) AS evidence FROM run JOIN documents d USING (doc_id) WHERE pos <= 3 GROUP BY 1),
an AS MATERIALIZED (SELECT item_id, text AS query, CASE WHEN evidence IS NULL THEN 'No context available.' ELSE split_part(evidence[1], '.', 1) || '.' END AS response FROM benchmark LEFT JOIN ev USING (item_id))"""
_NUMBERED = f"array_to_string(list_transform(evidence, lambda t, i: '[Doc ' || i || '] ' || {_STRIP.format('t')}), chr(10) || chr(10))"
_FAITH_HEAD = """Grade how well the evidence bears out the answer.
Every statement of the answer counts; what the evidence does not say counts against it, however likely it is.
1 means that all of it is borne out, 0 that nothing is. Reply with one number from 0 to 1.

Question:
"""
_QUALITY_HEAD = """Grade how well the answer meets the question.
It should be about what is asked, complete, clear and of use; whether it is true is not asked here.
1 means that it fully does, 0 that it does not at all. Reply with one number from 0 to 1.

Question:
"""
_CONSISTENT_HEAD = """Check an item of an evaluation set.
Do the passages together say that the answer is right for the question, and is at least one of them needed for that?
Begin the reply with yes or no.

Question: """
_NL = "chr(10) || chr(10)"
_FAITH = f"'{_FAITH_HEAD}' || query || {_NL} || 'Answer:' || chr(10) || response || {_NL} || 'Evidence:' || chr(10) || {_NUMBERED} || {_NL} || 'Score:'"
_QUALITY = f"'{_QUALITY_HEAD}' || coalesce(query, '') || {_NL} || 'Answer:' || chr(10) || coalesce(response, '') || {_NL} || 'Score:'"
SQL |= {
    "offline_answers": f"WITH {_FOUND} SELECT item_id, response FROM an",
    "llm_faithfulness_mock": f"WITH {_FOUND}, sc_ AS (SELECT {_HUNDREDTHS.format(_FAITH)} AS score FROM an JOIN ev USING (item_id)) {_mean('llm_faithfulness', '')}",
    "llm_answer_quality_mock": f"WITH {QA}, sc_ AS (SELECT {_HUNDREDTHS.format(_QUALITY)} AS score FROM qa) {_mean('llm_answer_quality', '')}",
    "simple_rag_answers": f"""WITH {CHUNKS}, dc AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_terms('text')}) AS term FROM chunks) GROUP BY ALL),
qc AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
idf AS MATERIALIZED (SELECT term, ln((1.0 + (SELECT count(*) FROM chunks)) / (1 + count(*))) + 1 AS idf FROM dc GROUP BY 1),
dw AS MATERIALIZED (SELECT chunk_id, term, tf * idf AS w FROM dc JOIN idf USING (term)), qw AS MATERIALIZED (SELECT item_id, term, tf * idf AS w FROM qc JOIN idf USING (term)),
nd AS (SELECT chunk_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1), nq AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
dot AS (SELECT item_id, chunk_id, sum(dw.w * qw.w) AS d FROM dw JOIN qw USING (term) GROUP BY ALL),
sc AS (SELECT b.item_id, c.chunk_id, c.text, coalesce(round(dot.d / (nd.n * nq.n), 9), 0.0) AS score FROM benchmark b CROSS JOIN chunks c LEFT JOIN dot ON dot.item_id = b.item_id AND dot.chunk_id = c.chunk_id LEFT JOIN nd ON nd.chunk_id = c.chunk_id LEFT JOIN nq ON nq.item_id = b.item_id),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS pos FROM sc QUALIFY pos <= 5)
SELECT item_id, string_agg(chunk_id, ' ' ORDER BY pos) AS retrieved, split_part(min_by(text, pos), '.', 1) || '.' AS response FROM top GROUP BY 1""",
    "all_tasks_mock": f"""SELECT 'single_hop' AS kind, CAST(sample_id AS VARCHAR) AS sample_id, query, answer, CAST(NULL AS VARCHAR) AS variant_of FROM ({SQL['single_hop_tasks_mock']})
UNION ALL SELECT 'multi_hop', sample_id, query, answer, NULL FROM ({SQL['multi_hop_tasks_mock']}) UNION ALL SELECT 'paraphrase', sample_id, query, NULL, CAST(variant_of AS VARCHAR) FROM ({SQL['paraphrase_fanout_mock']})""",
    "consistency_filter_mock": f"""WITH {CHUNKS}, t AS ({SQL['multi_hop_tasks_mock']})
SELECT sample_id, 'multi_hop' AS kind FROM t JOIN chunks x ON x.chunk_id = t.a JOIN chunks y ON y.chunk_id = t.b WHERE md5('{_CONSISTENT_HEAD}' || query || chr(10) || 'Answer: ' || answer || {_NL} || 'Passages:' || chr(10) || left(x.text || chr(10) || chr(10) || y.text, 4000) || {_NL} || 'Yes or no:')[1:1] < '8'""",
}


def _bert(pairs: str, idf: bool = False) -> str:
    """Common tables: bs_ with precision, recall and f1 of each pair (sample_id, a, b)."""
    vector = "list_transform(range(0, 16), lambda i: CAST('0x' || md5(t)[2 * i + 1:2 * i + 2] AS INTEGER) - 127.5)"
    side = lambda c: f"(SELECT sample_id, t, count(*) AS c FROM (SELECT sample_id, unnest({_terms(f"coalesce({c}, '')")}) AS t FROM pr_) GROUP BY ALL)"
    weight = "CASE WHEN df IS NULL THEN ln((SELECT count(*) FROM pr_) + 1) ELSE ln(((SELECT count(*) FROM pr_) + 1) / (df + 1)) END" if idf else "1.0"
    best = lambda x, y: f"(SELECT x.sample_id, x.t, any_value(x.c) AS c, max(list_inner_product(u.v, w.v)) AS best FROM {x} x JOIN {y} y ON x.sample_id = y.sample_id JOIN ve_ u ON u.t = x.t JOIN ve_ w ON w.t = y.t GROUP BY 1, 2)"
    share = lambda x, y: f"(SELECT sample_id, CASE WHEN sum(c * w) > 0 THEN sum(c * w * best) / sum(c * w) ELSE 0 END AS s FROM (SELECT b.*, {weight} AS w FROM {best(x, y)} b LEFT JOIN df_ ON df_.t = b.t) GROUP BY 1)"
    return f"""pr_ AS MATERIALIZED ({pairs}), ta_ AS MATERIALIZED {side('a')}, tb_ AS MATERIALIZED {side('b')}, df_ AS MATERIALIZED (SELECT t, count(*) AS df FROM tb_ GROUP BY 1),
vr_ AS (SELECT t, {vector} AS v FROM (SELECT t FROM ta_ UNION SELECT t FROM tb_)), ve_ AS MATERIALIZED (SELECT t, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM vr_),
p_ AS {share('ta_', 'tb_')}, r_ AS {share('tb_', 'ta_')},
bs_ AS MATERIALIZED (SELECT sample_id, coalesce(p_.s, 0) AS precision, coalesce(r_.s, 0) AS recall, CASE WHEN p_.s + r_.s > 0 THEN 2 * p_.s * r_.s / (p_.s + r_.s) ELSE 0 END AS f1 FROM pr_ LEFT JOIN p_ USING (sample_id) LEFT JOIN r_ USING (sample_id))"""


def _bert_means(other: str, idf: bool = False) -> str:
    one = lambda m: f"SELECT 'bertscore_{m}_{other}{'_idf' if idf else ''}' AS metric, round(coalesce(avg({m}), 0), 6) AS value, count(*) AS num_samples FROM bs_"
    return f"WITH {QA}, {_bert(f"SELECT sample_id, response AS a, {other} AS b FROM qa WHERE {other} <> ''", idf)} {' UNION ALL '.join(one(m) for m in ('precision', 'recall', 'f1'))}"


SQL |= {
    "bertscore_hashed": _bert_means("reference"),
    "bertscore_hashed_idf": _bert_means("query", True),
    "counterfactual_bertscore": f"""WITH {QA}, {LAB}, {_bert("SELECT v.sample_id, b.response AS a, v.response AS b FROM lab v JOIN lab b ON v.variant_of = b.sample_id WHERE v.scenario = 'counterfactual'")}
SELECT 'counterfactual_consistency' AS metric, round(coalesce(avg(f1), 0), 6) AS value, count(*) AS num_samples FROM bs_""",
}


def _bleu_rows(order: int = 4) -> str:
    """Common tables: bl_ with the white-space BLEU statistics of each row of lab that has a reference."""
    rows = "(SELECT * FROM lab WHERE reference IS NOT NULL)"
    parts = [f"o{n} AS MATERIALIZED (WITH {_overlap(_grams(_words('response'), n), _grams(_words('reference'), n), rows)} SELECT sample_id, nl, nr, shared FROM ov_)" for n in range(1, order + 1)]
    told = ", ".join(f"o{n}.shared AS m{n}, o{n}.nl AS t{n}" for n in range(1, order + 1))
    joins = " ".join(f"JOIN o{n} USING (sample_id)" for n in range(2, order + 1))
    return f"{', '.join(parts)}, bl_ AS MATERIALIZED (SELECT o1.sample_id, o1.nl AS pl, o1.nr AS rl, {told} FROM o1 {joins})"


def _bleu_formula(order: int = 4) -> str:
    """The value from sums pl, rl, m1.., t1..; orders from the first without n-grams on don't count."""
    logs, used, alive, zeros = [], [], "true", "0"
    for n in range(1, order + 1):
        alive = f"{alive} AND t{n} > 0"
        zeros = f"{zeros} + CASE WHEN m{n} = 0 THEN 1 ELSE 0 END"
        logs.append(f"CASE WHEN {alive} THEN ln(CASE WHEN m{n} = 0 THEN 1 / (pow(2, {zeros}) * t{n}) ELSE m{n} / t{n} END) ELSE 0 END")
        used.append(f"CASE WHEN {alive} THEN 1 ELSE 0 END")
    some = " + ".join(f"m{n}" for n in range(1, order + 1))
    return f"CASE WHEN {some} > 0 AND {' + '.join(used)} > 0 THEN (CASE WHEN pl >= rl THEN 1 ELSE exp(1 - rl / pl) END) * exp(({' + '.join(logs)}) / ({' + '.join(used)})) ELSE 0 END"


_SUMS = "sum(pl) AS pl, sum(rl) AS rl, " + ", ".join(f"CAST(sum(m{n}) AS DOUBLE) AS m{n}, CAST(sum(t{n}) AS DOUBLE) AS t{n}" for n in range(1, 5)) + ", count(*) AS n"
_SUBSETS = "su_ AS (SELECT sample_id, 'base' AS subset FROM lab WHERE variant_of IS NULL UNION ALL SELECT sample_id, 'noise' FROM lab WHERE scenario IN ('paraphrase', 'typo'))"


def _noise(name: str) -> str:
    """From va_ (subset, value, n)."""
    of = lambda s, c: f"coalesce((SELECT {c} FROM va_ WHERE subset = '{s}'), 0)"
    return f"""SELECT 'noise_robustness[{name}]' AS metric, round(CASE WHEN {of('base', 'value')} > 1e-8 THEN {of('noise', 'value')} / {of('base', 'value')} ELSE 0 END, 6) AS value, round({of('base', 'value')}, 6) AS base_score,
round({of('noise', 'value')}, 6) AS noise_score, CAST({of('base', 'n')} AS BIGINT) AS base_samples, CAST({of('noise', 'n')} AS BIGINT) AS noise_samples"""


_KIND = "coalesce(scenario, 'plain')"
_GRAMS2 = f"g_ AS MATERIALIZED (SELECT sample_id, unnest({_grams(_words('response'), 2)}) AS g FROM lab)"
SQL |= {
    "noise_robustness_bleu": f"WITH {QA}, {LAB}, {_bleu_rows()}, {_SUBSETS}, va_ AS (SELECT subset, {_bleu_formula()} AS value, n FROM (SELECT subset, {_SUMS} FROM bl_ JOIN su_ USING (sample_id) GROUP BY 1)) {_noise('bleu_4')}",
    "noise_robustness_distinct_2": f"""WITH {QA}, {LAB}, {_GRAMS2}, {_SUBSETS}, nn_ AS (SELECT subset, count(*) AS n FROM su_ GROUP BY 1),
va_ AS (SELECT nn_.subset, coalesce(v, 0) AS value, n FROM nn_ LEFT JOIN (SELECT subset, count(DISTINCT g) / count(*) AS v FROM g_ JOIN su_ USING (sample_id) GROUP BY 1) x ON x.subset = nn_.subset) {_noise('distinct_2')}""",
    "sliced_bleu": f"""WITH {QA}, {LAB}, {_bleu_rows()}, k_ AS (SELECT {_KIND} AS scenario, bl_.* FROM bl_ JOIN lab USING (sample_id))
SELECT scenario, 'scenario' AS level, round({_bleu_formula()}, 6) AS value, n AS num_samples FROM (SELECT scenario, {_SUMS} FROM k_ GROUP BY 1) UNION ALL SELECT NULL, 'total', round({_bleu_formula()}, 6), n FROM (SELECT {_SUMS} FROM k_)""",
    "sliced_distinct_2": f"""WITH {QA}, {LAB}, {_GRAMS2}, k_ AS (SELECT {_KIND} AS scenario, g FROM g_ JOIN lab USING (sample_id)), n_ AS (SELECT {_KIND} AS scenario, count(*) AS n FROM lab GROUP BY 1)
SELECT n_.scenario, 'scenario' AS level, round(coalesce(v, 0), 6) AS value, n AS num_samples FROM n_ LEFT JOIN (SELECT scenario, count(DISTINCT g) / count(*) AS v FROM k_ GROUP BY 1) x ON x.scenario = n_.scenario
UNION ALL SELECT NULL, 'total', round(count(DISTINCT g) / count(*), 6), (SELECT count(*) FROM lab) FROM g_""",
    "session_latency": """WITH o AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM o)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id AS key, count(*) AS n, round(avg(value), 6) AS mean_value, quantile_disc(value, 0.5) AS q50, quantile_disc(value, 0.95) AS q95 FROM s GROUP BY user_id, session""",
    "numbered_corpus": "SELECT 'hf_doc_' || (row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1) AS doc_id, md5(coalesce(text, '')) AS text_md5, source FROM documents",
}
_STOPPED = f"WHERE term NOT IN ({', '.join(repr(w) for w in ENGLISH)}) GROUP BY ALL"
SQL["tfidf_topk_english"] = SQL["tfidf_topk"].replace("FROM documents) GROUP BY ALL", f"FROM documents) {_STOPPED}").replace("FROM benchmark) GROUP BY ALL", f"FROM benchmark) {_STOPPED}")


def _stemmed_rouge(name: str, kind: str, other: str = "reference") -> str:
    rows = f"(SELECT * FROM qa WHERE {other} IS NOT NULL AND {other} <> '')"
    both = stemmed(_rouge("coalesce(response, '')"), _rouge(other), rows)
    told = common_subsequence("tk_") if kind == "L" else _overlap(_grams("l", int(kind)), _grams("r", int(kind)), "tk_")
    return _mean(name, f"WITH RECURSIVE {QA}, {both}, {told}, sc_ AS (SELECT {_F} AS score FROM ov_)")


def _similar(name: str, other: str = "reference") -> str:
    return _mean(name, f"WITH {QA}, {_hashed(f"SELECT sample_id, response AS a, {other} AS b FROM qa WHERE {other} <> ''", murmur=True)}")


def _bleu_13a(n: int) -> str:
    gram = lambda c: _grams(c, n)
    return f"(WITH {_overlap(gram('p'), gram('r'), 'bt_')} SELECT {n} AS n, sum(shared) AS m, CAST(sum(nl) AS BIGINT) AS t FROM ov_)"


_BLEU = f"""WITH {QA}, bt_ AS MATERIALIZED (SELECT sample_id, {_words(tokens_13a("coalesce(response, '')"))} AS p, {_words(tokens_13a('reference'))} AS r FROM qa WHERE reference IS NOT NULL),
bs AS MATERIALIZED ({' UNION ALL '.join(_bleu_13a(n) for n in range(1, 5))}),
be AS (SELECT *, bool_and(t > 0) OVER (ORDER BY n) AS alive, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n) AS zeros FROM bs),
bl AS (SELECT avg(ln(CASE WHEN m = 0 THEN 1 / (pow(2, zeros) * t) ELSE m / t END)) AS mean_log FROM be WHERE alive),
bn AS (SELECT sum(len(p)) AS np, sum(len(r)) AS nr, count(*) AS num_samples FROM bt_)
SELECT 'bleu_4' AS metric, round(CASE WHEN (SELECT sum(m) FROM bs) > 0 THEN CASE WHEN np >= nr THEN 1 ELSE exp(1 - nr / np) END * exp(mean_log) ELSE 0 END, 6) AS value, num_samples FROM bn, bl"""

SQL |= {
    "rouge_l_nostem": _mean("rouge_l_nostem", f"WITH RECURSIVE {QA}, tk_ AS (SELECT sample_id, {_rouge("coalesce(response, '')")} AS l, {_rouge('reference')} AS r FROM {_REF}), {common_subsequence('tk_')}, sc_ AS (SELECT {_F} AS score FROM ov_)"),
    "rouge1_answer": _stemmed_rouge("rouge1_answer", "1"),
    "rouge2_answer": _stemmed_rouge("rouge2_answer", "2"),
    "rouge_l_answer": _stemmed_rouge("rouge_l_answer", "L"),
    "rouge_l_query": _stemmed_rouge("rouge_l_query", "L", "query"),
    "embedding_similarity": _similar("embedding_similarity"),
    "bleu_4": _BLEU,
}

# the default plan: the ordinal, target and SQL of each metric
_PLAN = [(0, "RETRIEVAL_RELEVANCE" if m in ("recall", "precision", "hit_rate") else "RETRIEVAL_ACCURACY", f"SELECT * FROM ({SQL[f'{m}_at_k']}) WHERE metric = '{m}@5'") for m in ("recall", "precision", "hit_rate", "mrr", "map", "ndcg")]
_PLAN += [
    (1, "GENERATION_CORRECTNESS", SQL["exact_match"]),
    (2, "GENERATION_CORRECTNESS", SQL["token_f1"]),
    (3, "GENERATION_CORRECTNESS", SQL["rouge1_answer"]),
    (4, "GENERATION_CORRECTNESS", SQL["rouge2_answer"]),
    (5, "GENERATION_CORRECTNESS", _stemmed_rouge("rougeL_answer", "L")),
    (6, "GENERATION_CORRECTNESS", SQL["bleu_4"]),
    (7, "GENERATION_FAITHFULNESS", SQL["evidence_overlap_n1"]),
    (8, "GENERATION_CORRECTNESS", _similar("embedding_similarity_reference")),
    (9, "GENERATION_RELEVANCE", _similar("embedding_similarity_query", "query")),
]
SQL["plan_results"] = " UNION ALL ".join(f"SELECT CAST({at} AS INTEGER) AS ordinal, '{target}' AS target, metric, value, num_samples, CAST(0 AS BIGINT) AS num_errors FROM ({one})" for at, target, one in _PLAN)
