"""Every registered query and its SQL."""

from textloom.plans import corpus_queries, log_queries, source_queries, text_queries
from textloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "corpus_queries", "log_queries", "source_queries", "text_queries"]
