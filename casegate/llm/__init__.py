"""Operators for preparing training corpora."""

from casegate.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
