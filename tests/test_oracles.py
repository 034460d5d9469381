"""Every catalogue query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF_SMALL
from oracle_compare import compare

SQL = oracle_sql()


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    res = compare(queries()[name](spark, SF_SMALL), con, SQL[name])
    assert res["cols_match"], res
    assert res["rows_match"], res
    assert res["exact"], res


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = queries()[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["p_brand", "tag", "n"]
