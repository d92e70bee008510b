"""Every registered terrain query against its SQL on the smallest tables."""

import pytest

from geolode.plans import registry
from tests.conftest import DATA, oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(registry.QUERIES[name](spark, DATA)) == oracle_rows(duck, registry.SQL[name])


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
