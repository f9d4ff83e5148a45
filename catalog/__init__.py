"""Registered queries: each pairs a Spark query with SQL that computes the same answer."""

from catalog import (  # noqa: F401
    chat_queries, corpus_queries, findings_queries, report_queries, vector_queries,
    wiki_queries)
from catalog.registry import ORACLES, QUERIES  # noqa: F401
