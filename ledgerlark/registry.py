"""All queries of the library with the SQL that each is checked against."""

from __future__ import annotations

from .plans import queries_core, queries_operations, queries_planned, queries_stored

QUERIES = {**queries_core.QUERIES, **queries_planned.QUERIES, **queries_stored.QUERIES, **queries_operations.QUERIES}
ORACLE: dict[str, str] = {**queries_core.ORACLE, **queries_planned.ORACLE, **queries_stored.ORACLE, **queries_operations.ORACLE}
