"""All queries of the document engine and their SQL."""

from __future__ import annotations

from vellum.plans import corpus_queries, grounding_queries, quiz_queries, record_queries, scan_queries, structure_queries, text_queries

PARTS = [structure_queries, scan_queries, record_queries, text_queries, quiz_queries, grounding_queries, corpus_queries]
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
ORACLE_SQL = {k: s for p in PARTS for k, s in p.ORACLE_SQL.items()}
