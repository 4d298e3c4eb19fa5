"""Every core query against its SQL over whole tables; those without SQL must run and keep their columns."""

import pytest
from compare import connect, rows

from quarrylens import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data_dir, con, name):
    got = QUERIES[name](spark, data_dir).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_point(spark, data_dir):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
