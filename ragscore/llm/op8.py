"""Operator 8: substring dedup over words by an FM-index per shard.

Windows of 20 words that start earlier elsewhere are found as repeats.py describes; where several contents share an
anchor, a shard's runs are concatenated into a text, indexed (fm_index.py: wavelet matrix, backward search) and every
window is searched in lock-step; the smallest suffix position of its interval is the window's first place.  A window is
reported where that place comes before its own.

Defined cases: null text counts as empty; texts under 20 words lose nothing; rows that repeat an id and its text get the
same answer; a null id orders before all others; only the id and text columns are read, columns in ``carry`` go along
and give way to the operator's own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.repeats import without_repeats

WIDTH = 20
GRAM = 8


def substring_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, carry: list[str] = ()) -> DataFrame:
    """Id, n_units (words), n_removed, n_spans, removed (word spans), kept (UTF-8 words joined by one space)."""
    return without_repeats(documents, id_col, text_col, width, min(GRAM, width), "word", carry)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# windows are told apart by their MD5
OP8_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
marked AS MATERIALIZED (SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + {WIDTH - 1} <= len(w) THEN md5(array_to_string(w[i:i + {WIDTH - 1}], ' ')) END AS win FROM places),
firsts AS MATERIALIZED (SELECT win, min({{'d': doc_id, 'i': i}}) AS f FROM marked WHERE win IS NOT NULL GROUP BY 1),
told AS (SELECT r, i, word, max(CASE WHEN {{'d': doc_id, 'i': i}} > f THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked LEFT JOIN firsts USING (win)),
kept AS (SELECT r, sum(gone) AS n_removed, string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i) AS kept FROM told GROUP BY 1)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)
"""
