"""All registered queries of the engine and their SQL."""

from barloom.plans import allocation_queries, analytics, bar_queries, cointegration_queries, diagnostic_queries, learning_queries, model_queries, regime_queries, stream_queries, text_queries, trading_queries, volatility_queries  # noqa: F401  they register themselves
from barloom.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
