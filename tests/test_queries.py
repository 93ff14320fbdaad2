"""Every query over tables against its SQL."""

import pytest

from logtide import registry
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    if name not in registry.oracle_sql():
        assert len(got.columns)
        return
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
