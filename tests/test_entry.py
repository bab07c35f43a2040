import __spark_entry__ as entry


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["paper_id", "journal_id", "score", "rank"] and df.count() > 0
