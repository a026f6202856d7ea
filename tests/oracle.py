"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differences(df, con, sql) -> str:
    """Empty if both give the same columns and rows."""
    got = con.execute(sql)
    columns, rows = [c[0] for c in got.description], got.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(columns, rows)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; first only here: {[x for x in a if x not in set(b)][:2]}; first only there: {[x for x in b if x not in set(a)][:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ: {wrong[:2]}" if wrong else ""
