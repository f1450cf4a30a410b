"""Every query of the engine proper against its SQL."""

import pytest

from tests.oracle import compare
from vistalake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, name):
    compare(spark, SF, catalog.QUERIES[name], catalog.SQL[name])
