import __spark_entry__ as E


def test_registered(spark):
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0
