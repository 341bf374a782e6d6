"""All registered queries of the library."""

from __future__ import annotations

from cairn import registry
from cairn.plans import cultural_queries, engine_queries, evidence_queries, extra_queries, governance_queries, graph_queries, judging_queries, memory_queries, search_queries, stateful_queries, text_queries  # noqa: F401  registers its queries


def queries() -> dict:
    """Each query by name, as a function of session and dataset folder."""
    return {name: registry.run(name) for name in registry.QUERIES}


def oracle_sql() -> dict[str, str]:
    """The SQL with the same rows, by the same names."""
    return dict(registry.SQL)
