"""The engine's operators over the driver's tables, with the SQL that gives the same results."""

from . import library_queries, queries, rule_queries  # noqa: F401
