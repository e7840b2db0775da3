"""Importing the package registers every query."""
from . import desk_queries, indicator_queries, ledger_queries, market_queries, model_queries, pattern_queries, search_queries, session_queries, stats_queries, stream_queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "desk_queries", "indicator_queries", "ledger_queries", "market_queries", "model_queries", "pattern_queries", "search_queries", "session_queries", "stats_queries", "stream_queries"]
