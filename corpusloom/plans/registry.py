"""Queries over the reference's own operators, by name, with their SQL."""

from __future__ import annotations

from corpusloom.plans import codetext, collections, expansion, indexing, likeness, nearness, protocols, records, retrieval, scanning, search, stored, streams, textops, trees, upkeep

_MODULES = (codetext, collections, expansion, indexing, likeness, nearness, protocols, records, retrieval, scanning, search, stored, streams, textops, trees, upkeep)


def queries() -> dict:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
