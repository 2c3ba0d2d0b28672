import pytest

from strataloom.plans import registry
from tests.compare import connect, same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    assert name in registry.ORACLES
    same(registry.QUERIES[name](spark, FOLDER), connect(FOLDER), registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["candidate_id", "score", "kernel_connections"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
