import pytest
from bags import bag

from sparkwright.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", [*QUERIES])
def test_query(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    columns, expected = oracle(ORACLES[name])
    assert sorted(df.columns) == columns
    assert bag(df.collect()) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
