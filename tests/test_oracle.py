"""Every query of the catalogue against its DuckDB statement, or its shape if it has none."""

import pytest

import oracle
from casewright.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert oracle.compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], oracle.connect(sf_dir)) == ""


def test_every_statement_has_a_query():
    assert ORACLE_SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and "peak_risk" in rows.columns
