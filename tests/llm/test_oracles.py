import pytest

from changeweave.llm import registry

from ..conftest import SF, same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_operator_equals_sql(spark, duck, name):
    assert same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name]) > 0
