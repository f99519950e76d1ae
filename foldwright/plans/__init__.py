"""Registered queries over the given tables, each with an SQL text that states the same result."""

from foldwright.plans.registry import QUERIES, SQL, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
