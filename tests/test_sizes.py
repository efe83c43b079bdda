"""Queries on tables larger than the driver's, or of another shape, against their SQL."""

import duckdb

from reachlight.plans import relational


def test_closure_is_whole_beyond_a_million_rows(spark, tmp_path):
    """Keys that are there twice multiply what inherits from them; below a key that isn't there nothing does."""
    duckdb.sql(f"COPY (SELECT range AS p_partkey FROM range(1100000) WHERE range <> 5 UNION ALL SELECT * FROM (VALUES (7), (7), (22), (NULL), (-1))) TO '{tmp_path}/part.parquet'")
    db = duckdb.connect()
    db.execute(f"CREATE TABLE part AS SELECT * FROM '{tmp_path}/part.parquet'")
    db.execute(f"CREATE TABLE want AS {relational.ORACLE_SQL['recursive_closure']}")
    relational.recursive_closure(spark, str(tmp_path)).write.parquet(f"{tmp_path}/got")
    both = "SELECT p_partkey, depth, count(*) FROM {} GROUP BY ALL".format
    got = both(f"'{tmp_path}/got/*.parquet'")
    assert db.execute("SELECT count(*) FROM want").fetchone()[0] > 1_000_000
    assert not db.execute(f"(({both('want')}) EXCEPT ({got})) UNION ALL (({got}) EXCEPT ({both('want')}))").fetchall()
