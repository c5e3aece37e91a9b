"""Holds a query against its SQL in DuckDB: names, kinds and values, whatever the order of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([_plain(r[i]) for i in order] for r in records), key=repr)


def differs(df, sql: str, sf_dir: str) -> str | None:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = con.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != got[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} rows, as {bad[0]}" if bad else None
