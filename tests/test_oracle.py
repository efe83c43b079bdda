"""Every query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, folder, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.execute(SQL[name]).df()
    got = QUERIES[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_each_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
