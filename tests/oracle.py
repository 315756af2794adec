"""Compare a registered query with its SQL counterpart, value by value."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Spark type names next to the other engine's
TYPES = {
    "string": "VARCHAR",
    "double": "DOUBLE",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value + 0.0 if isinstance(value, float) else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: [(v is not None, str(v)) for v in r])


def mismatch(df, con, sql: str) -> str | None:
    """None when schema and values agree, else what differs."""
    result = con.execute(sql)
    theirs = {c[0]: str(c[1]) for c in result.description}
    ours = {n: TYPES.get(t, t) for n, t in df.dtypes}
    if ours != theirs:
        return f"schema {ours} != {theirs}"
    right = _rows(list(theirs), result.fetchall())
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}" if bad else None
