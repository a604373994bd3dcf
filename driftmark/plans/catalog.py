"""All registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from driftmark.plans import q_compare, q_edits, q_graph, q_masks, q_ops, q_registration, q_registry, q_scalars, q_stats, q_streaming, q_tracks  # noqa: F401  (they register)
from driftmark.plans.base import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
