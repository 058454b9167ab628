"""All queries of the core library with their oracle SQL, by name."""

from __future__ import annotations

from ledgerleaf.plans.base import ORACLES, QUERIES

from ledgerleaf.plans import evidence_queries, explanation_queries, graph_queries, index_queries, metric_queries, ranking_queries, text_queries  # noqa: F401, I001  (each registers its queries)

__all__ = ["ORACLES", "QUERIES"]
