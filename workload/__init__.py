"""Queries over the driver tables."""

from . import cell_queries, display_queries, live_queries, source_queries, store_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
