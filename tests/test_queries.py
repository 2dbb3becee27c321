"""Every registered query of the graph engine beside its SQL."""

import pytest

from lodestone import registry
from tests.compare import connect, differs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    if name in registry.ORACLE_SQL:
        assert differs(spark, duck, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
