"""Every registered query against its SQL on the smallest tables."""

import pytest

from verification.compare import table_of, views
from verification.oracle import ORACLE
from verification.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    mine = table_of(df.columns, [tuple(r) for r in df.collect()])
    assert mine[1]
    if name in ORACLE:
        found = con.execute(ORACLE[name])
        assert mine == table_of([c[0] for c in found.description], found.fetchall())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
