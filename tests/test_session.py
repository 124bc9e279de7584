from tessera import session


def test_materialise_and_sweep(spark):
    df = session.materialise(spark.range(10))
    assert df.count() == 10 and session.sweep(spark) >= 1 and session.sweep(spark) == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100
