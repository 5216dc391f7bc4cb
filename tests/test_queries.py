"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest

from corvane.plans import catalog
from tests.compare import DATA, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    same(catalog.QUERIES[name](spark, DATA), catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
