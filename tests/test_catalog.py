"""Every query of the engine beside the SQL that says what it means."""

from __future__ import annotations

import pytest

from sparkseek import catalog

from . import oracle

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return oracle.connection(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, con):
    got = QUERIES[name](spark, data).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)


def test_entry_is_a_page_of_hits(spark, data):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "score"]
    assert 0 < out.count() <= 10


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
