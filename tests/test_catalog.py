import pytest

from changeweave.plans import queries as catalog

from .conftest import SF, same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
