"""Compare a registered Spark query with its DuckDB twin (same rules as the driver:
columns sorted by name, row count, schema names, order-insensitive value hash)."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _norm(x):
    if x is None:
        return "NULL"
    if isinstance(x, float):
        if math.isnan(x):
            return "NULL"
        return repr(round(x, 6))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(_norm(y) for y in x) + "]"
    if hasattr(x, "asDict"):
        return _norm(tuple(x))
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{_norm(v)}" for k, v in sorted(x.items())) + "}"
    if hasattr(x, "tolist"):
        return _norm(x.tolist())
    return str(x)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return [columns[i] for i in order], lines, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, key, build, sql, sf_dir, con=None):
    df = build(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols, s_lines, s_hash = digest(df.columns, s_rows)
    out = {"key": key, "spark_rows": len(s_rows), "columns": s_cols}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_cols_raw = [d[0] for d in res.description]
    d_rows = res.fetchall()
    d_cols, d_lines, d_hash = digest(d_cols_raw, d_rows)
    out.update(duck_rows=len(d_rows), duck_columns=d_cols)
    ok = s_cols == d_cols and len(s_rows) == len(d_rows) and s_hash == d_hash
    out["status"] = "match" if ok else "MISMATCH"
    if not ok:
        ds = set(s_lines) - set(d_lines)
        dd = set(d_lines) - set(s_lines)
        out["only_spark"] = sorted(ds)[:3]
        out["only_duck"] = sorted(dd)[:3]
    return out
