import os

import pytest

import __spark_entry__ as entry
from fathomline.plans import catalog
from tests.compare import DATA, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, catalog.queries()[name], catalog.oracle_sql()[name]) == ([], [])


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_runs_without_sql(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
