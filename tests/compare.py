"""Runs queries in Spark and their SQL in DuckDB over one folder of tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in x.items()) + "}"
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return str(x)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def differences(spark, con, name, query, sql, folder) -> str:
    """Empty if both give the same rows under the same column names."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    if sorted(theirs_cols) != cols:
        return f"{name}: columns {cols} and {sorted(theirs_cols)}"
    at = [theirs_cols.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if mine == theirs:
        return ""
    return f"{name}: {sum(mine.values())} and {sum(theirs.values())} rows; only Spark {list((mine - theirs).items())[:3]}; only SQL {list((theirs - mine).items())[:3]}"
