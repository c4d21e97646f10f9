"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from tremor.llm import ann, exact_dedup, html_extract, language_id, license_scan, line_dedup, lm_score, mixing, packing, simhash

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_packing": packing.op2_packing,
    "op3_mixing": mixing.op3_mixing,
    "op4_simhash": simhash.op4_simhash,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_ann": ann.op6_ann,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_html_extract": html_extract.op10_html_extract,
}

ORACLES = {
    "op3_mixing": mixing.OP3_SQL,
    "op5_lm_score": lm_score.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
