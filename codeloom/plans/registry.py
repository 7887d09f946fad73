"""All queries of the engine by name, with the SQL that each must agree with."""

from __future__ import annotations

from codeloom.plans import lookups  # noqa: F401 - adds its queries
from codeloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
