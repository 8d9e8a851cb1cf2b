"""All queries of the library on the driver's tables, with the SQL that each is checked against."""

from __future__ import annotations

from . import aggregate_queries, curriculum_queries, document_queries, interval_queries, inventory_queries, join_queries, observation_queries, projection_queries, rally_queries, ranking_queries, routing_queries, rule_queries, series_queries, state_queries, validation_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregate_queries", "curriculum_queries", "document_queries", "interval_queries", "inventory_queries", "join_queries", "observation_queries", "projection_queries", "rally_queries", "ranking_queries", "routing_queries", "rule_queries", "series_queries", "state_queries", "validation_queries"]
