"""All queries of the schema-discovery tracks, and their SQL."""

from __future__ import annotations

from tablewright.plans import dependency_queries, feature_queries, manifest_queries, model_queries, more_queries, profile_queries, run_queries, stream_queries, text_quality_queries

MODULES = (profile_queries, dependency_queries, manifest_queries, run_queries, text_quality_queries, model_queries, feature_queries, stream_queries, more_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
