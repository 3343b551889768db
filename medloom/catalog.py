"""Every registered query of the engine and the SQL that says what it must return."""

from .plans import care_queries, log_queries, record_queries, rule_queries, search_queries, source_queries, stored_queries, stream_queries, view_queries  # noqa: F401  they register their queries
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
