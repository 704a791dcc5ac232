"""Registered queries over records derived from the shared tables."""

from .catalog import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
