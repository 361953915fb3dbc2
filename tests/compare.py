"""Compare a query with its SQL on the same tables, value by value, whatever the order of rows."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

from plumbrow.plans.inputs import TABLES

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return _sorted([d[0] for d in cur.description], cur.fetchall())


def differences(df, con, sql) -> str | None:
    """None if both results are the same, else what differs first."""
    got_cols, got = spark_rows(df)
    want_cols, want = duck_rows(con, sql)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"{a} != {b}"
    return None
