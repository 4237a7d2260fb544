import os

import pytest

import __spark_entry__ as entry
from lectern import queries
from tests.duck import SF, both

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the sample tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    got, wanted = both(spark, queries.QUERIES[name], queries.SQL[name])
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and len({(r.channel, r.seq) for r in rows}) == len(rows)
    assert max(sum(r.channel == c for r in rows) for c in {r.channel for r in rows}) <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
