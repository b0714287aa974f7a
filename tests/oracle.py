"""Holds a Spark result against DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import datetime as dt
import math
import os


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def views(con, sf_dir: str) -> None:
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE OR REPLACE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")


def difference(df, con, sql: str) -> str:
    """'' if equal."""
    columns = sorted(df.columns)
    got = sorted(tuple(str(value(r[c])) for c in columns) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    at = [names.index(c) for c in columns]
    want = sorted(tuple(str(value(r[i])) for i in at) for r in cur.fetchall())
    if got == want:
        return ""
    a, b = [r for r in got if r not in want][:3], [r for r in want if r not in got][:3]
    return f"{len(got)} and {len(want)} rows; only in Spark {a}; only in DuckDB {b}"
