"""All named queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from corpusloom.plans import further, matrices, networks, pairs, texts
from corpusloom.plans.tables import SQL, Q

__all__ = ["ORACLE_SQL", "QUERIES", "further", "matrices", "networks", "pairs", "texts"]

QUERIES = Q
ORACLE_SQL = SQL
