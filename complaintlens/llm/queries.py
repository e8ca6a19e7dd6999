"""The registered corpus queries."""

from complaintlens.llm import heavy_queries, light_queries, search_queries  # noqa: F401
from complaintlens.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
