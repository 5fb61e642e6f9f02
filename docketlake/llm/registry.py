"""Queries and SQL twins of this subpackage."""

from __future__ import annotations

from importlib import import_module

#: query name -> (module, function, name of the SQL text in the module or None)
ENTRIES = {
    "op1_main_text": ("html_main", "op1_main_text", None),
    "op2_near_dedup": ("near_dedup", "op2_near_dedup", "OP2_SQL"),
    "op3_decontaminate": ("decontaminate", "op3_decontaminate", "OP3_SQL"),
    "op4_quality_rules": ("fertility", "op4_quality_rules", None),
    "op5_language": ("language", "op5_language", None),
    "op6_chat": ("chat", "op6_chat", "OP6_SQL"),
    "op7_token_counts": ("token_rollup", "op7_token_counts", None),
    "op8_quality_classifier": ("ordinal", "op8_quality_classifier", None),
    "op9_line_dedup": ("line_dedup", "op9_line_dedup", "OP9_SQL"),
    "op10_mix": ("mixing", "op10_mix", "OP10_SQL"),
    "op11_manifest": ("manifest", "op11_manifest", "OP11_SQL"),
    "op12_embedding_dedup": ("vectors", "op12_embedding_dedup", "OP12_SQL"),
    "op13_fill_in_middle": ("infill", "op13_fill_in_middle", "OP13_SQL"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"docketlake.llm.{mod}"), fn) for name, (mod, fn, _) in ENTRIES.items()}


def oracle_sql() -> dict:
    return {name: getattr(import_module(f"docketlake.llm.{mod}"), sql) for name, (mod, _, sql) in ENTRIES.items() if sql}
