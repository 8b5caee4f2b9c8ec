"""Comparison of a query with its SQL: columns by name, rows in any order, floats to six digits."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())


def rows_of_sql(con, sql: str):
    rel = con.sql(sql)
    columns = sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    return columns, sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
