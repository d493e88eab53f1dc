"""Registry of the engine's own queries: name -> (query, oracle SQL or None)."""

from __future__ import annotations

FLAGSHIP = "a8_claim_aggregate"


def _modules():
    from folium.plans import acronyms, composites, drafts, evaluation, evidence, joins, markdown, metadata, models, names, notes, pages, parsing, raters, rates, retrieval, rules, stores, texts, traces, trends, vectors

    return [acronyms, composites, drafts, evaluation, evidence, joins, markdown, metadata, models, names, notes, pages, parsing, raters, rates, retrieval, rules, stores, texts, traces, trends, vectors]


def queries() -> dict:
    return {name: fn for m in _modules() for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.QUERIES.items() if sql}
