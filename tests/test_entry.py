import __spark_entry__ as entry


def test_names():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) >= 45


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["user_id", "readings", "value", "first_type", "last_type", "tags"]
