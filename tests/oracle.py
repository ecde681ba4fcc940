"""Comparison of a query's rows with those of its SQL on DuckDB."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, Decimal)):
        return str(int(v)) if v == int(v) else f"{float(v):.10g}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if abs(v) < 1e15 and v == int(v) else f"{v:.10g}"
    return str(v)


def same_rows(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert ours == theirs
