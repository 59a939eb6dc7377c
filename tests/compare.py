"""Runs registered queries in Spark and DuckDB and compares the rows as multisets."""

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in records)


def difference(df, con, sql):
    """None when equal, else a short description."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = rows(names, result.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    return (
        f"{sum(got.values())} rows, want {sum(want.values())};"
        f" extra {list((got - want).items())[:2]}; missing {list((want - got).items())[:2]}"
    )


def records(df, *columns):
    rows = df.select(*columns) if columns else df
    return [tuple(_plain(v) for v in row) for row in rows.collect()]


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value.isoformat()
    return value
