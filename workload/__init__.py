"""Registered queries on the driver tables, each with SQL that says what it must give."""

from importlib import import_module

from workload.registry import QUERIES

for _module in (
    "functions_queries", "quality_queries", "capture_queries", "temporal_queries",
    "reaction_queries", "search_queries", "file_queries", "policy_queries", "sync_queries",
    "stream_queries", "object_documents",
):
    import_module(f"workload.{_module}")

ALL_QUERIES = dict(QUERIES)
