"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .conversations import OP11_SQL, op11_conversation_repair
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .html_text import op9_html_extraction
from .merkle import OP12_SQL, op12_merkle_manifest
from .packing import op2_best_fit_packing
from .pii import op4_pii
from .quality_model import op10_quality_classifier
from .quality_rules import op7_quality_rules
from .simhash import op3_simhash_near_dedup
from .substring_dedup import op8_substring_dedup
from .toxicity import op5_toxicity
from .window_filling import op13_window_filling

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_window_filling": op13_window_filling,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
