"""Operators for large-scale training-data pipelines, one module each.

``QUERIES`` holds the thin contract queries, ``ORACLES`` the DuckDB SQL of those
that SQL can express; nothing outside this subpackage imports it.
"""

from factloom.llm import ann, exact_dedup, html_extract, line_dedup, mixing, near_dedup, pii, quality, sentencepiece_viterbi, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality": quality.op2_quality,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_nearest": ann.op6_nearest,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sentencepiece": sentencepiece_viterbi.op9_sentencepiece,
    "op10_html_text": html_extract.op10_html_text,
}
ORACLES = {
    "op3_source_mix": mixing.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_line_dedup": line_dedup.SQL,
}
