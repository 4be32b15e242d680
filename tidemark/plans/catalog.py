"""All registered queries."""

from __future__ import annotations

from tidemark.plans import join_queries, model_queries, row_queries, sequence_queries, split_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
