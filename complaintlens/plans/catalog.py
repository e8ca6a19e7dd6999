"""All registered queries."""

from complaintlens.plans import answer_queries, text_queries, vector_queries  # noqa: F401
from complaintlens.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
