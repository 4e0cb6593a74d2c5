"""All queries of the library with their SQL."""

from __future__ import annotations

from . import answer_queries, corpus_queries, reader_queries, span_queries, text_queries, veto_queries

MODULES = (text_queries, corpus_queries, veto_queries, span_queries, answer_queries, reader_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
