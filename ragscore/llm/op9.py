"""Operator 9: suffix-array dedup over bytes.

Strings of 100 bytes that start earlier elsewhere are found as repeats.py describes.  The suffixes that can decide
anything are range-partitioned by the eight bytes at their anchor, at splitters that Spark samples; a bucket's suffixes
are sorted by multikey quicksort (multikey.py).  Equal strings have equal anchors, so an equal pair never lies on the
two sides of a splitter and the comparison across boundaries is empty by construction.  The dense array of all suffixes
is not built: even as 8 leading bytes and an 8-byte place for each suffix it is 16 bytes for each byte of text.

Defined cases: null text counts as empty; texts under 100 bytes lose nothing; rows that repeat an id and its text get
the same answer; a null id orders before all others; only the id and text columns are read, columns in ``carry`` go
along and give way to the operator's own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragscore.llm.repeats import without_repeats

WIDTH = 100
GRAM = 32


def suffix_array_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, carry: list[str] = ()) -> DataFrame:
    """Id, n_units (bytes), n_removed, n_spans, removed (byte spans), kept (bytes)."""
    return without_repeats(documents, id_col, text_col, width, min(GRAM, width), "byte", carry)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_array_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# windows are told apart by their MD5
OP9_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT r, doc_id, b, unnest(range(1, octet_length(b) + 1)) AS i FROM docs),
marked AS MATERIALIZED (SELECT r, doc_id, i, hex(b[i:i]) AS byte, CASE WHEN i + {WIDTH - 1} <= octet_length(b) THEN md5(b[i:i + {WIDTH - 1}]) END AS win FROM places),
firsts AS MATERIALIZED (SELECT win, min({{'d': doc_id, 'i': i}}) AS f FROM marked WHERE win IS NOT NULL GROUP BY 1),
told AS (SELECT r, i, byte, max(CASE WHEN {{'d': doc_id, 'i': i}} > f THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WIDTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked LEFT JOIN firsts USING (win)),
runs AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS starts FROM told),
kept AS (SELECT r, sum(gone) AS n_removed, sum(starts) AS n_spans, string_agg(CASE WHEN gone = 0 THEN byte END, '' ORDER BY i) AS kept FROM runs GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
