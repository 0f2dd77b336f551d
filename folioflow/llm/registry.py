"""The queries and SQL of this subpackage, as the entry module adds them."""

from __future__ import annotations

from folioflow.llm import classifier, html_main, licenses, lines, mixing, pieces, pii, quality_rules, simhash, topk

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_licenses": licenses.op2_licenses,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_quality": classifier.op4_quality,
    "op5_simhash": simhash.op5_simhash,
    "op6_html": html_main.op6_html,
    "op7_topk": topk.op7_topk,
    "op8_pieces": pieces.op8_pieces,
    "op9_lines": lines.op9_lines,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
#: The others cannot be said in SQL (64-bit xxHash, models, wrappers, tokenizers); tests/llm holds them against plain versions.
SQL = {"op1_pii": pii.OP1_SQL, "op2_licenses": licenses.OP2_SQL, "op3_mix_sources": mixing.OP3_SQL, "op7_topk": topk.OP7_SQL, "op9_lines": lines.OP9_SQL}
