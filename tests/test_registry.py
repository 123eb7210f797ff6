import os

import pytest

import __spark_entry__ as entry

SMALL = entry.SMALL


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", ["r01_bm25", "e01_e05_metrics", "a02_statistics", "r05_parse", "p6_found"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SMALL}/{t}'")
    df = entry.queries()[name](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
