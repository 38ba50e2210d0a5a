"""Every query of the library against its SQL on a second engine, or for rows where SQL cannot express it."""

from __future__ import annotations

import pytest
from conftest import SF, rows_of

from cytoloom.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows_of(got) == rows_of(duck.sql(SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
