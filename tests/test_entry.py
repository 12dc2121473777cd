"""The driver contract: every query has a schema; entry runs."""
import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 218
    assert set(df.columns) == {"kind", "fusion_model", "correct", "total", "accuracy"}


def test_every_oracle_has_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 26
