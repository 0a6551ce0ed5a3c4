"""All queries over the reference's operators, by name, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly, linkage, records, reporting, scoring

_FAMILIES = (reporting, scoring, linkage, records, assembly)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _family in _FAMILIES:
    QUERIES |= _family.QUERIES
    ORACLE_SQL |= _family.ORACLE_SQL
