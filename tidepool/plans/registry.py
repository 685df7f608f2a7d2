"""All queries of the engine's own operators, by name, with their SQL."""

from __future__ import annotations

from tidepool.plans import corpus, retrieval, tables

FLAGSHIP = "fts_bm25_or"
QUERIES = retrieval.QUERIES | corpus.QUERIES | tables.QUERIES
ORACLE_SQL = retrieval.ORACLE_SQL | corpus.ORACLE_SQL | tables.ORACLE_SQL
