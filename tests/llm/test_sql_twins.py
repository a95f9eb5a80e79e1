"""The numbered queries against their SQL, over a small copy of the tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = con.execute(entry.LLM_ORACLES[name])
    columns = sorted(c[0] for c in cursor.description)
    want = sorted((tuple(dict(zip([c[0] for c in cursor.description], r))[c] for c in columns) for r in cursor.fetchall()), key=repr)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want and want
