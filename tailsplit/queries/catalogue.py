"""All registered queries: importing the modules below fills the registry."""

from tailsplit.queries import grading, scoring, splitting, tables, trees  # noqa: F401
from tailsplit.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
