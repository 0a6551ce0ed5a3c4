"""Small tables of fixed values, built without a Python worker."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def _shown(x) -> str:
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x!r}D" if isinstance(x, float) else "NULL" if x is None else str(x)


def literal_rows(spark: SparkSession, ddl: str, rows: Iterable[tuple]) -> DataFrame:
    """``rows`` as a table of the planner's own; texts, numbers and nulls only."""
    names, kinds = zip(*(x.strip().split(" ") for x in ddl.split(",")), strict=True)
    listed = ", ".join("(" + ", ".join(map(_shown, r)) + ")" for r in rows)
    if not listed:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True)) + " WHERE false")
    return spark.sql(f"SELECT {', '.join(f'CAST(c{i} AS {k}) AS {n}' for i, (n, k) in enumerate(zip(names, kinds, strict=True)))} FROM VALUES {listed} AS t({', '.join(f'c{i}' for i in range(len(names)))})")
