"""All queries of the relevance engine and their SQL, without those of the training-text operators."""

from __future__ import annotations

from lexaline import file_queries, matrix_queries, model_queries, oracles, queries

QUERIES = queries.QUERIES | file_queries.QUERIES | matrix_queries.QUERIES | model_queries.QUERIES
ORACLES = oracles.ORACLES | file_queries.ORACLES | matrix_queries.ORACLES | model_queries.ORACLES
