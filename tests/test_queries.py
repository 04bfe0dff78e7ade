"""Every registered query of the engine's own operators against its SQL in DuckDB, row by row."""

import math

import duckdb
import pytest

from latticeweave.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return plain(float(v)) if type(v).__name__ == "Decimal" else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    assert got == ordered(tuple(plain(r[at.index(c)]) for c in names) for r in found.fetchall())
    assert got


def test_stretched_points_on_edges(spark, tmp_path):
    """A point on each edge that parts two of the line's cells and that a row can lie on, and a few beside them: half-open cells, as in the SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT 12 * i + k AS l_orderkey, 25 * i AS l_partkey, 1::INT AS l_linenumber, (128 * (i + 1) + k * 0.01)::DOUBLE AS l_extendedprice FROM range(0, 80) a(i), range(0, 3) b(k)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = [(r.ci, r.points, plain(r.total)) for r in QUERIES["overlap_stretched"](spark, str(tmp_path)).collect()]
    want = con.execute(ORACLE_SQL["overlap_stretched"]).fetchall()
    assert sorted(got) == sorted((ci, n, plain(total)) for ci, n, total in want)
    assert sorted(r[:2] for r in got) == [(2 * i, 3) for i in range(80)]
