"""Operators of a training-data pipeline; nothing else in the library imports them."""

from kinweave.llm import queries
from kinweave.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "queries"]
