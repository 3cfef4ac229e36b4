"""All queries of the library but those of its optional subpackage."""

from __future__ import annotations

from .plans import files, runs  # noqa: F401  their queries register themselves
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
