"""The driver's contract."""

import __spark_entry__ as entry


def test_registries():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 80
    assert set(oracles) <= set(queries)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
