"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    cols = sorted(df.columns)
    return [cols, *sorted(tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))]


def names():
    from fathomline.plans import SQL

    return sorted(SQL)


@pytest.mark.parametrize("name", names())
def test_query_equals_oracle(spark, duck, name):
    from fathomline.plans import QUERIES, SQL

    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
