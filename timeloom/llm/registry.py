"""Queries and SQL of the operations in this subpackage."""

from __future__ import annotations

import importlib

#: query -> (module, function, name of its SQL there or None)
_QUERIES = {
    "op1_redirect_equivalence": ("url_filters", "OP1_SQL"),
    "op2_curriculum_mix": ("mixing", "OP2_SQL"),
    "op3_zstd_language": ("language_id", None),
    "op4_inverted_multi_index": ("vector_search", None),
    "op5_piece_counts": ("token_counts", None),
    "op6_license_rules": ("license_scan", "OP6_SQL"),
    "op8_latent_leaks": ("decontamination", None),
    "op9_weighted_minhash": ("near_dedup", None),
    "op7_line_dedup": ("line_dedup", "OP7_SQL"),
    "op10_wrapper_text": ("html_extract", None),
    "op11_norm_of_sum_codes": ("vector_codes", "OP11_SQL"),
    "op12_pair_counts": ("token_alignment", None),
    "op13_boosted_quality": ("quality", None),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"timeloom.llm.{module}"), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"timeloom.llm.{module}"), sql) for name, (module, sql) in _QUERIES.items() if sql}
