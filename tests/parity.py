"""Compare a Spark result with a DuckDB result of the same name: columns, rows, values."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(files):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    if hasattr(x, "asDict"):
        return tuple(value(y) for y in x)
    if isinstance(x, dict):
        return tuple(value(y) for y in x.values())
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    return x


def difference(df, sql: str, folder: str) -> str | None:
    """None if both give the same rows; else what differs."""
    con = connect(folder)
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    order, rows = sorted(range(len(theirs)), key=lambda i: theirs[i]), cursor.fetchall()
    ours = sorted(df.columns)
    if ours != sorted(theirs):
        return f"columns {ours} and {sorted(theirs)}"
    left = Counter(tuple(value(r[c]) for c in ours) for r in df.collect())
    right = Counter(tuple(value(r[i]) for i in order) for r in rows)
    if left == right:
        return None
    return f"{sum(left.values())} and {sum(right.values())} rows; only ours {list((left - right).items())[:3]}; only SQL {list((right - left).items())[:3]}"
