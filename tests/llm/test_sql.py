import pytest

from graphloom.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, name):
    assert compare(spark, connect(SMALL), SMALL, QUERIES[name], ORACLE_SQL[name]) is None
