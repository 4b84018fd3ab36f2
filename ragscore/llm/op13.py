"""Operator 13: secrets in texts, with the parts of a credential linked by an interval join.

A scan of every whole text finds the parts.  Three kinds are reported by themselves: assignments to a word for a secret
(assign), access identifiers (access) and long hexadecimal runs (hex).  Three more are weak and are reported only where
parts that complement them lie within SCOPE code points in the same document:

- id, a name for who logs in with a value: needs a secret part, of which one is an assignment unless an endpoint is there too;
- secret, a bare token of 20 or more characters with capitals, small letters and digits: needs an identifier, of which one
  is an access identifier unless an endpoint is there too;
- endpoint, a URL: needs an identifier and a secret part.

access and id are identifiers; assign, hex and secret are secret parts.  A weak candidate that overlaps a base span is
dropped, as is an endpoint that overlaps an id, and a token that overlaps either.

The join is by place: a part is filed under the stretches of SCOPE code points that it covers, a weak candidate also
under its neighbours', and both meet on (document, stretch).  A stretch holds no more parts than fit into it, so a text
of any length, or one that holds a third of all parts, is split like any other; only parts are shuffled, never texts.

Defined cases: a null text counts as empty; no part gives zero counts, the digest of nothing and no spans; repeated and
null ids are rows of their own; other columns are not read.  Places are code points; letters outside ASCII never match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.common import written

SCOPE = 200
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "id", "secret", "endpoint")
IDENTIFIERS, SECRETS = ("access", "id"), ("assign", "hex", "secret")


def _any_case(words: str) -> str:
    """Letters in either case; an ignore-case flag would also match letters outside ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_GAP = r"""["']?\x20*[:=]\x20*["']?"""
#: The words that the base kinds and the weak identifiers begin with.
ASSIGN = f"({_any_case('password|passwd|secret|token|api_?key')}){_GAP}([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ID = f"({_any_case('client_?id|account|username|user|login')}){_GAP}([A-Za-z0-9_.@-]+)"
ENDPOINT = "[a-z][a-z0-9+]*://[A-Za-z0-9._:@/-]+"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
LEAST_ASSIGNED, LEAST_ID = 6, 4


def _free(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of found (sorted, apart from each other) that overlap none of taken (sorted by start)."""
    out, j, reach = [], 0, -1
    for s, e in found:
        while j < len(taken) and taken[j][0] < e:
            reach = max(reach, taken[j][1])
            j += 1
        if reach <= s:
            out.append((s, e))
    return out


class Scanner:
    """All parts of a text as (kind, start, end)."""

    def __init__(self) -> None:
        self.assign, self.access, self.hex, self.id, self.endpoint, self.token = (re.compile(p) for p in (ASSIGN, ACCESS, HEX, ID, ENDPOINT, TOKEN))

    def parts(self, text: str) -> Iterator[tuple[int, int, int]]:
        spans = {
            "assign": [m.span() for m in self.assign.finditer(text) if len(m[2]) >= LEAST_ASSIGNED],
            "access": [m.span() for m in self.access.finditer(text)] if "AKIA" in text else [],
            "hex": [m.span() for m in self.hex.finditer(text)],
        }
        base = sorted(s for found in spans.values() for s in found)
        spans["id"] = _free([m.span() for m in self.id.finditer(text) if len(m[2]) >= LEAST_ID], base)
        taken = sorted(base + spans["id"])
        spans["endpoint"] = _free([m.span() for m in self.endpoint.finditer(text)], taken) if "://" in text else []
        mixed = [m.span() for m in self.token.finditer(text) if _mixed(m[0])]
        spans["secret"] = _free(mixed, sorted(taken + spans["endpoint"]))
        for kind, found in spans.items():
            for s, e in found:
                yield KINDS.index(kind), s, e


def _mixed(token: str) -> bool:
    return any("A" <= c <= "Z" for c in token) and any("a" <= c <= "z" for c in token) and any("0" <= c <= "9" for c in token)


_PART = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        parts = [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.parts(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(parts, pa.list_(_PART))], ["doc_id", "parts"])


def _kind(*names: str) -> Column:
    return F.col("other_kind").isin([KINDS.index(n) for n in names])


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """row, kind, start, end: the weak ones of parts (row, kind, start, end) whose complements lie within scope."""
    stretch = lambda start, end: F.explode(F.sequence(F.floor(start / scope).cast("long"), F.floor(end / scope).cast("long"))).alias("stretch")
    weak = parts.where(F.col("kind") >= len(BASE)).select("row", "kind", "start", "end", stretch(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    other = parts.select("row", F.col("kind").alias("other_kind"), F.col("start").alias("s"), F.col("end").alias("e"), stretch(F.col("start"), F.col("end")))
    gap = F.greatest("start", "s") - F.least("end", "e")
    met = weak.join(other, ["row", "stretch"]).where((gap <= scope) & ((F.col("kind") != F.col("other_kind")) | (F.col("start") != F.col("s"))))
    seen = {"identifier": _kind(*IDENTIFIERS), "secret": _kind(*SECRETS), "access": _kind("access"), "assign": _kind("assign"), "endpoint": _kind("endpoint")}
    got = met.groupBy("row", "kind", "start", "end").agg(*[F.max(c).alias(f"has_{n}") for n, c in seen.items()])
    is_id, is_secret = (F.col("kind") == KINDS.index(k) for k in ("id", "secret"))
    enough = (
        F.when(is_id, F.col("has_secret") & (F.col("has_assign") | F.col("has_endpoint")))
        .when(is_secret, F.col("has_identifier") & (F.col("has_access") | F.col("has_endpoint")))
        .otherwise(F.col("has_identifier") & F.col("has_secret"))
    )
    return got.where(enough).select("row", "kind", "start", "end")


def _told(parts: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda p: F.concat_ws(":", F.get(name, p["kind"]), p["start"].cast("string"), p["end"].cast("string"))), ",")


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, parts: for each document its base spans and linked weak ones, as (kind, start, end); kinds are places in KINDS."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, parts array<struct<kind:int,start:long,end:long>>"
    found = rows.mapInArrow(_scanned, kept)
    found = written(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "parts"), "parts")  # written, so that row numbers stay
    parts = found.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    added = linked(parts, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))  # no more than one row holds anyway
    base = F.filter("parts", lambda p: p["kind"] < len(BASE))
    return found.join(added, "row", "left").select(F.col("doc_id").alias(doc_id), base.alias("base"), F.coalesce("added", F.array().cast("array<struct<kind:int,start:long,end:long>>")).alias("added"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of_kind = lambda k: F.filter("base", lambda p: p["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{n}") for k, n in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.concat("base", "added")).alias("spans"))


def _sql_spans(kind: str, pattern: str, test: str) -> str:
    """Spans of a pattern: matches and what lies between them, with running lengths."""
    p = pattern.replace("'", "''")
    return f"""{kind}_m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(string_split_regex(text, '{p}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS i FROM texts WHERE regexp_matches(text, '{p}')),
{kind}_s AS (SELECT doc_id, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM {kind}_m),
{kind}_a AS (SELECT doc_id, {KINDS.index(kind)} AS kind, CAST(stop - length(m) AS BIGINT) AS s, CAST(stop AS BIGINT) AS e FROM {kind}_s WHERE {test})"""


def _apart(kind: str, *taken: str) -> str:
    return f"{kind}_f AS (SELECT * FROM {kind}_a a WHERE NOT EXISTS (SELECT 1 FROM ({' UNION ALL '.join(f'SELECT * FROM {t}' for t in taken)}) t WHERE t.doc_id = a.doc_id AND t.s < a.e AND t.e > a.s))"


_VALUE = lambda p: p.replace("'", "''")
_BASES = ("assign_a", "access_a", "hex_a")
_NAMED = f"(['{"', '".join(KINDS)}'])[kind + 1] || ':' || s || ':' || e"
OP13_SQL = f"""
WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_sql_spans("assign", ASSIGN, f"length(regexp_extract(m, '{_VALUE(ASSIGN)}', 2)) >= {LEAST_ASSIGNED}")},
{_sql_spans("access", ACCESS, "true")},
{_sql_spans("hex", HEX, "true")},
{_sql_spans("id", ID, f"length(regexp_extract(m, '{_VALUE(ID)}', 2)) >= {LEAST_ID}")},
{_sql_spans("endpoint", ENDPOINT, "true")},
{_sql_spans("secret", TOKEN, "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')")},
{_apart("id", *_BASES)}, {_apart("endpoint", *_BASES, "id_f")}, {_apart("secret", *_BASES, "id_f", "endpoint_f")},
base AS MATERIALIZED (SELECT * FROM assign_a UNION ALL SELECT * FROM access_a UNION ALL SELECT * FROM hex_a),
weak AS MATERIALIZED (SELECT * FROM id_f UNION ALL SELECT * FROM endpoint_f UNION ALL SELECT * FROM secret_f),
parts AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM weak),
near AS (SELECT w.doc_id, w.kind, w.s, w.e, bool_or(p.kind IN (1, 3)) AS i, bool_or(p.kind IN (0, 2, 4)) AS c, bool_or(p.kind = 1) AS acc, bool_or(p.kind = 0) AS asg, bool_or(p.kind = 5) AS ep
  FROM weak w JOIN parts p ON p.doc_id = w.doc_id AND greatest(p.s, w.s) - least(p.e, w.e) <= {SCOPE} AND NOT (p.kind = w.kind AND p.s = w.s) GROUP BY ALL),
added AS (SELECT doc_id, kind, s, e FROM near WHERE CASE kind WHEN 3 THEN c AND (asg OR ep) WHEN 4 THEN i AND (acc OR ep) ELSE i AND c END),
b AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg({_NAMED}, ',' ORDER BY s, kind) AS told FROM base GROUP BY 1),
t AS (SELECT doc_id, string_agg({_NAMED}, ',' ORDER BY s, kind) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY 1)
SELECT texts.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(told, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN b ON b.doc_id = texts.doc_id LEFT JOIN t ON t.doc_id = texts.doc_id
"""
