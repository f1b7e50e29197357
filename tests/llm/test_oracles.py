import pytest
from regionloom.llm import queries

from ..oracle import assert_same, connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connection(SF), queries.ORACLE_SQL[name])
