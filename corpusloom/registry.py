"""All queries of the core library with their SQL."""

from __future__ import annotations

from .plans import annotation_queries, duplicate_queries, metric_queries, source_queries, text_queries  # noqa: F401  (they register their queries)
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
