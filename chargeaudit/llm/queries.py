"""Registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from chargeaudit.llm.decontaminate import op2_decontaminate
from chargeaudit.llm.html_text import op1_html_text
from chargeaudit.llm.lm import op5_lm_score
from chargeaudit.llm.manifest import OP12_SQL, op12_merkle_manifest
from chargeaudit.llm.near_join import op8_near_join
from chargeaudit.llm.quality import op3_quality_rules
from chargeaudit.llm.repeats import op7_substring_dedup
from chargeaudit.llm.secrets import op6_secret_scan
from chargeaudit.llm.spelling import OP11_SQL, op11_spelling_variants
from chargeaudit.llm.token_counts import op10_token_counts
from chargeaudit.llm.token_files import op4_token_files
from chargeaudit.llm.tokens_bpe import op9_byte_bpe
from chargeaudit.llm.toxicity import op13_toxicity

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_files": op4_token_files,
    "op5_lm_score": op5_lm_score,
    "op6_secret_scan": op6_secret_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_join": op8_near_join,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_toxicity": op13_toxicity,
}

SQL: dict[str, str] = {"op11_spelling_variants": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
