"""Run a catalogue query in Spark and its oracle in DuckDB, then compare.

Mirrors the driver's check: column names (sorted), row count, and an
order-insensitive comparison of the values. Values are compared exactly after
type normalisation (so a rounding disagreement is a failure, as it would be
for a value hash); ``approx`` only helps to diagnose a failure.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return int(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, sorted(rows, key=_key)


def duck_rows(con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    data = res.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, sorted(rows, key=_key)


def _close(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    return a == b


def compare(df, con, sql) -> dict:
    scols, srows = spark_rows(df)
    dcols, drows = duck_rows(con, sql)
    out = {"cols_match": scols == dcols, "spark_cols": scols, "duck_cols": dcols,
           "spark_rows": len(srows), "duck_rows": len(drows)}
    out["rows_match"] = len(srows) == len(drows)
    out["exact"] = out["cols_match"] and srows == drows
    out["approx"] = out["cols_match"] and out["rows_match"] and all(
        _close(a, b) for ra, rb in zip(srows, drows) for a, b in zip(ra, rb))
    if not out["exact"]:
        diffs = [(a, b) for a, b in zip(srows, drows) if a != b]
        out["first_diffs"] = diffs[:3]
    return out
