"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, spark, con):
    got = queries.queries()[name](spark, SF).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
