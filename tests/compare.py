"""Rows of a Spark query against those of DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(folder, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(type(x).__name__ == "str"), x if not isinstance(x, float) else round(x, 6)) for x in row)


def _plain(x):
    if isinstance(x, float) and not math.isnan(x) and x == int(x):
        return int(x)
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted([tuple(_plain(r[k]) for k in order) for r in data], key=_key)


def differences(df, con, sql: str) -> str:
    """What differs, or nothing."""
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want_names, want = rows([c[0] for c in found.description], found.fetchall())
    if got_names != want_names:
        return f"columns {got_names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want):
        same = all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b))
        if not same:
            return f"{a} and {b}"
    return ""
