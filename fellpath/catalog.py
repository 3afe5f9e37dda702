"""All queries of the library and their SQL oracles, by name."""

from __future__ import annotations

from fellpath.plans import change_queries, graph_queries, network_queries, planning_queries, record_queries, ride_queries, rule_queries, sequence_queries, source_queries, text_queries
from fellpath.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ENTRY", "ORACLE_SQL", "QUERIES", "change_queries", "graph_queries", "planning_queries", "record_queries", "ride_queries", "rule_queries", "sequence_queries", "source_queries", "text_queries"]

ENTRY = network_queries.nearest_snap
