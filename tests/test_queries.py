"""Every array query against its SQL on a small table of the driver, where there is one."""

import os

import duckdb
import pytest

from gridloom import queries, queries_stored

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES | queries_stored.QUERIES))
def test_query(spark, name):
    found = (queries.QUERIES | queries_stored.QUERIES)[name](spark, SF)
    oracle = queries.ORACLE | queries_stored.ORACLE
    rows = sorted(tuple(r) for r in found.select(*sorted(found.columns)).collect())
    if name not in oracle:
        assert rows
        return
    con = duckdb.connect()
    for table in ("orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in sorted(found.columns))} FROM ({oracle[name]})").fetchall()
    assert rows == sorted(expected)
