"""Queries of the training-data operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from ragscore.llm.op1 import op1_toxicity
from ragscore.llm.op2 import OP2_SQL, OP7_SQL, op2_exact_top_k
from ragscore.llm.op3 import op3_best_fit_packing
from ragscore.llm.op4 import op4_simhash_near_dedup
from ragscore.llm.op5 import op5_bpe
from ragscore.llm.op6 import op6_html_extraction
from ragscore.llm.op7 import op7_embedding_near_dedup
from ragscore.llm.op8 import OP8_SQL, op8_substring_dedup
from ragscore.llm.op9 import OP9_SQL, op9_suffix_array_dedup
from ragscore.llm.op10 import op10_language_id
from ragscore.llm.op11 import OP11_SQL, op11_spelling_variants
from ragscore.llm.op12 import op12_embedding_whitening
from ragscore.llm.op13 import OP13_SQL, op13_secret_scan

_ALL = (
    op1_toxicity,
    op2_exact_top_k,
    op3_best_fit_packing,
    op4_simhash_near_dedup,
    op5_bpe,
    op6_html_extraction,
    op7_embedding_near_dedup,
    op8_substring_dedup,
    op9_suffix_array_dedup,
    op10_language_id,
    op11_spelling_variants,
    op12_embedding_whitening,
    op13_secret_scan,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op2_exact_top_k": OP2_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op8_substring_dedup": OP8_SQL,
    "op9_suffix_array_dedup": OP9_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op13_secret_scan": OP13_SQL,
}
