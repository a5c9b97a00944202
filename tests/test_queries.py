import pytest

from tessera.plans import catalog
from tests.duck import assert_same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, sf, name):
    assert_same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


def test_flagship(spark, sf_small):
    assert catalog.flagship(spark, sf_small).count() > 0
