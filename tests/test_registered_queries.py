"""Every registered query with SQL gives the SQL's rows; all others give rows."""

import __spark_entry__ as entry
import duckdb
import pytest
from intervale.plans.oracles import oracle_sql
from intervale.plans.queries import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(smallest):
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{smallest}/{t}.parquet'")
    return made


def cells(rows):
    return sorted([tuple("" if v is None else repr(float(v) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, smallest, name):
    df = queries()[name](spark, smallest)
    columns = sorted(df.columns)
    got = cells(df.select(*columns).collect())
    want = cells(con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_has_rows(spark, smallest, name):
    assert queries()[name](spark, smallest).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
