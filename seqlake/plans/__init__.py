"""Logs over the driver's tables, and the registered queries with their SQL."""

from .queries import entry, oracle_sql, queries  # noqa: F401
