import os
import re

import pytest

import __spark_entry__ as entry
from lectern.llm import queries
from tests.duck import SF, both

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the sample tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    got, wanted = both(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert got == wanted


def test_one_query_for_each_operator_and_the_pipeline():
    names = list(entry.queries())
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert "pipeline" in names
