"""The reference operators' queries by name, and their SQL for DuckDB.

Every query runs over its whole table.  Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from . import files, sequences, text

QUERIES: dict = text.QUERIES | files.QUERIES | sequences.QUERIES
ORACLE_SQL: dict[str, str] = text.ORACLE_SQL | files.ORACLE_SQL | sequences.ORACLE_SQL
