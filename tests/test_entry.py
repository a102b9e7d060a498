"""The driver contract."""

import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).count() > 0
    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) >= 80
