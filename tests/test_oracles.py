"""Every registered query of the library that has SQL gives the SQL's rows."""

import pytest

from lotwatch import registry
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    assert name in registry.ORACLES
    assert difference(registry.QUERIES[name](spark, sf_dir), sf_dir, registry.ORACLES[name]) == ""
