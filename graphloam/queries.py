"""All registered queries of the code-graph operators and their SQL."""

from __future__ import annotations

from graphloam.plans import derived, graph, guides, joins, placement, rows, rules, scalars, text, view, views  # noqa: F401  each registers its queries
from graphloam.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
