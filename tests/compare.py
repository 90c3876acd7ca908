"""Order-insensitive comparison of a Spark result with DuckDB rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def same_as_sql(df, con, sql):
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    a = canon(df.columns, df.collect())
    b = canon(ocols, cur.fetchall())
    assert a[0] == b[0], f"columns {a[0]} vs {b[0]}"
    assert len(a[1]) == len(b[1]), f"rows {len(a[1])} vs {len(b[1])}"
    missing = [r for r in a[1] if r not in set(b[1])][:3]
    assert a[1] == b[1], f"spark-only rows {missing}"
    return len(a[1])
