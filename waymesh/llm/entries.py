"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from importlib import import_module

#: Module, query and the name of its SQL text (None: SQL can't express it).
ENTRIES = [
    ("media_chunks", "op1_media_chunks", None),
    ("secret_scan", "op2_secret_ownership", "SQL"),
    ("lm_scoring", "op3_lattice_lm", None),
    ("html_extract", "op5_html_extract", None),
    ("language_id", "op4_language_id", None),
    ("toxicity", "op6_toxicity", None),
    ("packing", "op7_packing", None),
    ("decontaminate", "op8_decontamination", "SQL"),
    ("jaccard_join", "op9_jaccard_join", "SQL"),
    ("line_dedup", "op10_line_dedup", "SQL"),
    ("source_divergence", "op11_source_divergence", "SQL"),
    ("code_books", "op12_vector_codes", None),
    ("byte_bpe", "op13_byte_bpe", None),
]


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name, _ in ENTRIES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for module, name, sql in ENTRIES if sql}
