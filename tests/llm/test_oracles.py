"""The queries that SQL can express, against their SQL in DuckDB."""

import duckdb
import pytest

from latticeweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries.QUERIES[name](spark, folder)
    found = con.execute(queries.ORACLE_SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in at) for r in df.collect()), key=str)
    assert got == sorted(found.fetchall(), key=str) and got
