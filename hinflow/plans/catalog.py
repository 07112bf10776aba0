"""All queries of the library, by name."""

from __future__ import annotations

from . import graph_queries, metric_queries, sampling_queries, sketch_queries  # noqa: F401
from .registry import QUERIES, SQL, query, register_operator

__all__ = ["QUERIES", "SQL", "query", "register_operator"]
