"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from fieldloom.plans.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def ordered(rows):
    return sorted(tuple((x is not None, 0 if x is None else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df, sql = QUERIES[name](spark, SMALL), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    assert ordered(df.select(*columns).collect()) == ordered(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})").fetchall())



def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
