"""All queries of the library, one per operator, with their SQL counterparts."""

from __future__ import annotations

from . import anchor_queries, bins_queries, distance_queries, evaluate_queries, linear_queries, neighbour_queries, profile_queries, rules_queries, selection_queries, shapley_queries, tree_queries, treeshap_queries  # noqa: F401
from .common import QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
