from dataclasses import replace

import pytest

from condensq.plans.catalog import ORACLES, QUERIES, learning
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module", autouse=True)
def few_trees():
    """The models' full size is run at larger scales; here 25 trees for some 40 rows will do."""
    full = learning.FOREST
    learning.FOREST = replace(full, trees=25)
    yield
    learning.FOREST = full


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and not df.isEmpty()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
