"""Comparison of queries with their SQL in DuckDB, as rows in any order."""

from __future__ import annotations

import glob
import os
from datetime import date, datetime, timezone
from decimal import Decimal

import duckdb

DATA = os.environ.get("FINWEAVE_DATA", "/root/testdata/sf0.01")


def plain(x):
    if isinstance(x, datetime):
        return x.astimezone(timezone.utc).replace(tzinfo=None).isoformat() if x.tzinfo else x.isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, Decimal):
        return format(x.normalize() + 0, "f")
    if isinstance(x, float):
        return round(x, 6) if x == x else None
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(df, sql: str, data: str = DATA) -> tuple[list[str], list[str], int]:
    """Rows only in Spark's result, rows only in DuckDB's, and their number."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    theirs = rows_of(names, got.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    from collections import Counter

    a, b = Counter(ours), Counter(theirs)
    return list((a - b).elements()), list((b - a).elements()), len(ours)
