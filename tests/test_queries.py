"""Every query with SQL gives the rows of the SQL on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(SF):
    pytest.skip("the test tables aren't here", allow_module_level=True)

from tracelens.plans import queries as Q  # noqa: E402


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in Q.ORACLE_SQL:
        assert got
        return
    rel = db.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(tuple(plain(v) for v in r)) for r in rel.fetchall())
    assert sorted(str(tuple(plain(r[c]) for c in columns)) for r in got) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "func", "label", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())
