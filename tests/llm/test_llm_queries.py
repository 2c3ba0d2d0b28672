import pytest

from strataloom.llm import queries
from tests.compare import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
