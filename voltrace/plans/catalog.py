"""All named queries over the supplied tables, and the SQL that must give the same rows."""

from __future__ import annotations

from . import cohorts, evaluation, learning, names, reporting, splits, targets, text  # noqa: F401  the modules enter their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
