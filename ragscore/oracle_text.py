"""DuckDB SQL of text measures that take several steps: Porter stems, longest common subsequences, 13a tokens, murmur3.

Each function gives common tables, for use behind WITH RECURSIVE.
"""

from __future__ import annotations

from ragscore.functions.kernels import PORTER_STEP2, PORTER_STEP3, PORTER_STEP4


def _shape(w: str) -> str:
    """Letters as C and V; a y after a consonant is a vowel."""
    s = f"regexp_replace(regexp_replace(translate({w}, 'aeiou', 'VVVVV'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        s = f"replace(replace({s}, 'Cy', 'CV'), 'Vy', 'VC')"
    return s


def _m(cut: int) -> str:
    """Porter's measure of a word of shape s without its last letters."""
    return f"len(regexp_extract_all(s[1:length(s) - {cut}], 'V+C+'))"


def _cvc(cut: int) -> str:
    return f"(s[1:length(s) - {cut}] LIKE '%CVC' AND NOT regexp_matches(w[1:length(w) - {cut}], '[wxy]$'))"


_DOUBLE = "(length(w) > 1 AND w[-1] = w[-2] AND s[-1] = 'C')"


def _suffixes(rules: list[tuple[str, str]]) -> str:
    """The longest suffix that fits is the one that counts, whether or not its condition holds."""
    cases = [f"WHEN w LIKE '%{old}' THEN CASE WHEN {_m(len(old))} > 0 THEN w[1:length(w) - {len(old)}] || '{new}' ELSE w END" for old, new in sorted(rules, key=lambda r: -len(r[0]))]
    return f"CASE {' '.join(cases)} ELSE w END"


def _step4() -> str:
    cases = []
    for old in sorted(PORTER_STEP4, key=len, reverse=True):
        also = f" AND regexp_matches(w, '[st]{old}$')" if old == "ion" else ""
        cases.append(f"WHEN w LIKE '%{old}' THEN CASE WHEN {_m(len(old))} > 1{also} THEN w[1:length(w) - {len(old)}] ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stems(tokens: str) -> str:
    """st_ (t, stem) for the tokens that the query gives as t; those of up to three letters stay."""
    parts, at = [f"st0 AS MATERIALIZED (SELECT DISTINCT t, t AS w, false AS cut FROM ({tokens}) WHERE length(t) > 3)"], 0

    def step(w: str, cut: str = "false") -> None:
        nonlocal at
        at += 1
        parts.append(f"st{at} AS MATERIALIZED (SELECT t, {w} AS w, {cut} AS cut FROM (SELECT *, {_shape('w')} AS s FROM st{at - 1}))")

    step("CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN w[1:length(w) - 2] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[1:length(w) - 1] ELSE w END")
    ed = "w LIKE '%ed' AND w NOT LIKE '%eed' AND contains(s[1:length(s) - 2], 'V')"
    ing = "w LIKE '%ing' AND contains(s[1:length(s) - 3], 'V')"
    step(f"CASE WHEN w LIKE '%eed' AND {_m(3)} > 0 THEN w[1:length(w) - 1] WHEN {ed} THEN w[1:length(w) - 2] WHEN {ing} THEN w[1:length(w) - 3] ELSE w END", f"({ed}) OR ({ing})")
    step(f"CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN {_DOUBLE} AND w[-1] NOT IN ('l', 's', 'z') THEN w[1:length(w) - 1] WHEN {_m(0)} = 1 AND {_cvc(0)} THEN w || 'e' ELSE w END")
    step("CASE WHEN w LIKE '%y' AND contains(s[1:length(s) - 1], 'V') THEN w[1:length(w) - 1] || 'i' ELSE w END")
    step(_suffixes(PORTER_STEP2))
    step(_suffixes(PORTER_STEP3))
    step(_step4())
    step(f"CASE WHEN w LIKE '%e' AND ({_m(1)} > 1 OR {_m(1)} = 1 AND NOT {_cvc(1)}) THEN w[1:length(w) - 1] ELSE w END")
    step(f"CASE WHEN {_m(0)} > 1 AND {_DOUBLE} AND w[-1] = 'l' THEN w[1:length(w) - 1] ELSE w END")
    return ", ".join([*parts, f"st_ AS MATERIALIZED (SELECT t, w AS stem FROM st{at})"])


def stemmed(left: str, right: str, rows: str) -> str:
    """tk_ (sample_id, l, r): both token lists, stemmed."""
    return f"""raw_ AS MATERIALIZED (SELECT sample_id, {left} AS l, {right} AS r FROM {rows}),
each_ AS MATERIALIZED (SELECT sample_id, 0 AS side, unnest(l) AS t, unnest(range(len(l))) AS i FROM raw_ UNION ALL SELECT sample_id, 1, unnest(r), unnest(range(len(r))) FROM raw_),
{stems("SELECT t FROM each_")},
both_ AS (SELECT sample_id, side, list(coalesce(stem, t) ORDER BY i) AS x FROM each_ LEFT JOIN st_ USING (t) GROUP BY ALL),
tk_ AS MATERIALIZED (SELECT sample_id, coalesce(a.x, []) AS l, coalesce(b.x, []) AS r FROM raw_ LEFT JOIN (FROM both_ WHERE side = 0) a USING (sample_id) LEFT JOIN (FROM both_ WHERE side = 1) b USING (sample_id))"""


def common_subsequence(tokens: str) -> str:
    """ov_ (sample_id, nl, nr, shared): lengths of both lists of a table (sample_id, l, r), and of what they share in order.

    A row of the usual table for each token of l, as a running maximum.
    """
    return f"""dp_ AS (SELECT sample_id, l, r, 0 AS i, list_transform(r, lambda x: 0) AS row_ FROM {tokens}
  UNION ALL SELECT sample_id, l, r, i + 1, list_transform(new_, lambda x, j: list_max(new_[1:j])) FROM (
    SELECT *, list_transform(r, lambda x, j: greatest(row_[j], coalesce(row_[j - 1], 0) + CASE WHEN x = l[i + 1] THEN 1 ELSE 0 END)) AS new_ FROM dp_ WHERE i < len(l) AND len(r) > 0)),
ov_ AS MATERIALIZED (SELECT sample_id, len(l) AS nl, len(r) AS nr, coalesce(max(row_[-1]), 0) AS shared FROM dp_ GROUP BY ALL)"""


def tokens_13a(text: str) -> str:
    """The text with blanks between its 13a tokens."""
    x = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{old}', '{new}')"
    x = f"' ' || {x} || ' '"
    for old, new in ((r"([{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{old}', '{new}', 'g')"
    return x


def _u(n: int) -> str:
    return f"CAST({n} AS UBIGINT)"


def _low(x: str) -> str:
    return f"(({x}) & {_u(0xFFFFFFFF)})"


def _little(x: str) -> str:
    """The number that eight hex digits in x give, lowest byte first."""
    return f"CAST('0x' || {x}[7:8] || {x}[5:6] || {x}[3:4] || {x}[1:2] AS UBIGINT)"


def _turned(x: str, by: int) -> str:
    return _low(f"({x} << {by}) | ({x} >> {32 - by})")


def murmur3(tokens: str, buckets: int = 4096) -> str:
    """mm_ (t, b): the bucket that the absolute value of the signed 32-bit hash gives to each token t of the query."""
    scrambled = lambda k: _low(f"{_turned(k, 15)} * {_u(0x1B873593)}")
    first = lambda k: _low(f"{k} * {_u(0xCC9E2D51)}")
    return f"""mm0 AS MATERIALIZED (SELECT DISTINCT t, hex(encode(t)) AS x FROM ({tokens})),
mm1 AS (SELECT *, list_transform(range(length(x) // 8), lambda i: x[8 * i + 1:8 * i + 8]) AS blocks, rpad(x[8 * (length(x) // 8) + 1:], 8, '0') AS tail FROM mm0),
mm2 AS (SELECT *, list_transform(list_transform(blocks, lambda z: {first(_little('z'))}), lambda k: {scrambled('k')}) AS ks, {first(_little('tail'))} AS k FROM mm1),
mm3 AS (SELECT t, x, list_reduce(list_prepend({_u(0)}, ks), lambda h, k: {_low(f"{_turned('xor(h, k)', 13)} * {_u(5)} + {_u(0xE6546B64)}")}) AS h, {scrambled('k')} AS k FROM mm2),
mm4 AS (SELECT t, xor(xor(h, k), CAST(length(x) // 2 AS UBIGINT)) AS h FROM mm3),
mm5 AS (SELECT t, {_low(f"xor(h, h >> 16) * {_u(0x85EBCA6B)}")} AS h FROM mm4),
mm6 AS (SELECT t, {_low(f"xor(h, h >> 13) * {_u(0xC2B2AE35)}")} AS h FROM mm5),
mm7 AS (SELECT t, CAST(xor(h, h >> 16) AS BIGINT) AS h FROM mm6),
mm_ AS MATERIALIZED (SELECT t, least(h, 4294967296 - h) % {buckets} AS b FROM mm7)"""
