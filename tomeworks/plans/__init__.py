"""Registered queries over the test tables, each with its SQL statement of the same result."""

from tomeworks.plans import (  # noqa: F401
    builder_queries, chunk_queries, document_queries, file_queries, log_queries, quality_queries, retrieval_queries, sketch_queries,
    trace_queries, understanding_queries,
)
from tomeworks.plans.base import HEADLINE, QUERIES, STATEMENTS

__all__ = ["HEADLINE", "QUERIES", "STATEMENTS"]
