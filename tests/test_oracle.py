"""Every query that SQL can say, against DuckDB on the smallest tables."""

import pytest

from oracle import assert_same, duck
from quaystone.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(registry.queries()[name](spark, sf).toPandas(), duck(SQL[name], sf))
    spark.catalog.clearCache()
