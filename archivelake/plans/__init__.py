"""Composed queries over the test tables."""

from archivelake.plans import (
    merged_queries,
    normalize_queries,
    overview_queries,
    patch_queries,
    search_queries,
    stream_queries,
    thread_queries,
)
from archivelake.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "merged_queries",
    "normalize_queries",
    "overview_queries",
    "patch_queries",
    "search_queries",
    "stream_queries",
    "thread_queries",
]
