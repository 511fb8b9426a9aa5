"""All queries over the driver's tables."""

from __future__ import annotations

from headway.plans import board_queries, context_queries, geo_queries, history_queries, model_queries, source_queries, text_queries  # noqa: F401  each adds its own
from headway.plans.bindings import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
