"""The catalogue of named queries with their oracles."""

from placefabric.plans import data_queries, geo_queries, journey_queries, more_queries, user_queries, vector_queries  # noqa: F401
from placefabric.plans.registry import ORACLES, QUERIES

FLAGSHIP = "alg4_fallback_feed"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
