"""Compare a Spark result with DuckDB's, rows in any order."""

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (float, Decimal)):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    return str(v)


def same(got, want):
    """got: a DataFrame; want: a DuckDB relation."""
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    at = [want.columns.index(c) for c in names]
    b = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert len(a) == len(b)
    assert a == b
