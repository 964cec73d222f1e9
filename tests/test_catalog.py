"""Every query of the catalog against its DuckDB counterpart, over the smallest tables."""

import pytest

from stockroom import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
