import os

import pytest

from riacho.plans import ORACLES, QUERIES
from tests.compare import FOLDER, same

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"probe"}))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns


def test_entry_has_all_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
