"""Registered queries and their SQL: QUERIES and ORACLE hold those of all modules here."""

from . import accounts, crawl, edits  # noqa: F401  they register on import
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
