"""All registered queries over the given tables and their DuckDB twins."""

from __future__ import annotations

from lodeframe.plans import more_queries, row_queries, source_queries, spatial_queries, text_queries, view_queries  # noqa: F401  register their queries
from lodeframe.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
