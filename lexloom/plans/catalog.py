"""All queries of the library and their SQL."""

from __future__ import annotations

from lexloom.plans import ask, evaluation_queries, harness_queries, ingest_queries, perturbation_queries, record_queries, registry_queries, text_queries

_PARTS = (text_queries, registry_queries, evaluation_queries, record_queries, perturbation_queries, harness_queries, ingest_queries)
QUERIES = {"ask": ask.flagship, "ask_hybrid": ask.ask_hybrid, **{name: f for part in _PARTS for name, f in part.QUERIES.items()}}
SQL = {"ask": ask.FLAGSHIP_SQL, "ask_hybrid": ask.HYBRID_SQL, **{name: sql for part in _PARTS for name, sql in part.SQL.items()}}
