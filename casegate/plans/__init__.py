from casegate.plans import file_queries, log_queries, redesign_queries, rule_queries  # noqa: F401
from casegate.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
