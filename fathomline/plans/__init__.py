"""Registered queries of the engine and their oracle SQL."""

from . import decision_queries, frame_queries, fulltext_queries, machine_queries, reference_queries, rendering_queries, retrieval_queries, scoring_queries, signal_queries, telemetry_queries, ticket_queries, verdict_queries

_MODULES = (telemetry_queries, scoring_queries, retrieval_queries, decision_queries, fulltext_queries, ticket_queries, machine_queries, frame_queries, signal_queries, verdict_queries, rendering_queries, reference_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
