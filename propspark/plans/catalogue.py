"""All registered queries."""

from propspark.plans.registry import QUERIES, SQL
from propspark.plans import queries_scoring, queries_analytics, queries_clean, queries_enrich, queries_quality, queries_rest  # noqa: F401

__all__ = ["QUERIES", "SQL"]
