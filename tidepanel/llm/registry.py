"""Queries of this subpackage."""

from __future__ import annotations

from tidepanel.llm import html_text, jaccard_join, language_id, mixing, pieces, secret_scan, token_tables, toxicity, vectors

QUERIES = {
    "op1_vantage_trees": vectors.op1_vantage_trees,
    "op2_html_text": html_text.op2_html_text,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_token_tables": token_tables.op5_token_tables,
    "op6_exact_top_k": vectors.op6_exact_top_k,
    "op7_language_id": language_id.op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
ORACLES = {"op6_exact_top_k": vectors.OP6_SQL, "op8_mixing": mixing.OP8_SQL}
