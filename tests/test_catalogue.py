"""Every catalogue query against its SQL."""

import pytest

from tessera import catalogue


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    b = sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert a == b
