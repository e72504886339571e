import pytest
from compare import assert_same

from quarrymill.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(set(df.columns)) == len(df.columns) and len(df.collect()) > 0
