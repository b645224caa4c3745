"""Run oracle SQL on DuckDB and compare it with a Spark result (tests only).

The comparison is order-insensitive: both results are reduced to sorted lists
of canonical row tuples (column names sorted, decimals at fixed scale, floats
rounded, timestamps as ISO text, NULL/NaN/NaT as None).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

from disputelens.sources.tables import DRIVER_TABLES


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return names, types, cur.fetchall()


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return format(v.quantize(decimal.Decimal("0.01")), "f") if v == v else None
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return bool(v)
    return v


def canon_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_names = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    d_names, _, d_rows = duck_rows(con, sql)
    if sorted(s_names) != sorted(d_names):
        return False, f"columns differ: spark={sorted(s_names)} duck={sorted(d_names)}"
    if len(s_rows) != len(d_rows):
        return False, f"row count differ: spark={len(s_rows)} duck={len(d_rows)}"
    a, b = canon_rows(s_names, s_rows), canon_rows(d_names, d_rows)
    if a != b:
        names = sorted(s_names)
        for x, y in zip(a, b):
            if x != y:
                diff = {n: (p, q) for n, p, q in zip(names, x, y) if p != q}
                return False, f"values differ, first row diff: {diff}"
    return True, f"{len(s_rows)} rows match"
