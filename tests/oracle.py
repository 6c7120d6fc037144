"""Runs a query in Spark and its SQL in DuckDB and compares the rows as bags."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark, name: str, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    columns, expected = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns), name
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, expected)
    assert got == want, f"{name}: only Spark {list((got - want).items())[:3]}, only SQL {list((want - got).items())[:3]}"
