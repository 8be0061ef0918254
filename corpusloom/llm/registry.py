"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_sharding": "sharding",
    "op2_byte_bpe": "bytebpe",
    "op3_token_store": "tokenstore",
    "op4_source_mix": "mixing",
    "op5_quality_fm": "quality",
    "op6_ann_ivfpq": "neighbours",
    "op7_pii_spans": "pii",
    "op8_jaccard_join": "jaccard",
    "op9_line_rules": "linerules",
    "op10_language_id": "langid",
    "op11_best_fit_packing": "packing",
    "op12_lexical_search": "lexsearch",
    "op13_source_divergence": "divergence",
}
#: Those whose module states its SQL.
_WITH_SQL = ("op8_jaccard_join", "op12_lexical_search", "op13_source_divergence")


def queries() -> dict:
    return {name: getattr(import_module(f"corpusloom.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"corpusloom.llm.{_MODULES[name]}").ORACLE for name in _WITH_SQL}
