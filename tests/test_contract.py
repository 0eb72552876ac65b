"""The driver's contract: names, registration, and each query with SQL against DuckDB on the smallest data."""

import datetime as dt
import decimal
import importlib
import sys
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
entry_module = importlib.import_module("__spark_entry__")


def test_registration():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    for n in (2, 3, 5):
        assert f"p{n}_found" in queries
    assert all(callable(f) for f in queries.values())


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 4)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_core_queries_equal_their_sql(spark):
    import duckdb

    from caudal.plans import registry

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    differ = []
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, str(DATA))
        cols = sorted(df.columns)
        cur = con.execute(sql)
        names = [c[0] for c in cur.description]
        want = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()], key=repr) if sorted(names) == cols else None
        if sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr) != want:
            differ.append(name)
    assert not differ
