"""Run registered queries against their SQL twins and report differences."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, type(v).__name__, v) for v in r))


_KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = dict(zip(cols, [str(d[1]) for d in cur.description]))
    expected = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    types = {c: _KIND.get(t, t) for c, t in df.dtypes}
    wrong = {c: (types[c], kinds[c]) for c in cols if types[c] != kinds[c]}
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)} rows; e.g. {_sample(got, expected)}"
    if got != expected:
        return f"values differ: {_sample(got, expected)}"
    if wrong:
        return f"types differ: {wrong}"
    return None


def _sample(got, expected):
    a, b = set(got), set(expected)
    return f"only spark {sorted(a - b, key=repr)[:3]} / only sql {sorted(b - a, key=repr)[:3]}"
