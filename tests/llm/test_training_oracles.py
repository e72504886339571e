import pytest
from compare import assert_same

from quarrymill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.01")
