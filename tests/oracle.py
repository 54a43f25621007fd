"""Compares a query with its SQL twin on one folder of tables."""

import math
from pathlib import Path

import duckdb


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "None"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{x:.6g}" if abs(x) < 1e6 else str(int(x))
    return str(x)


def rows(spark_df):
    cols = sorted(spark_df.columns)
    return sorted(tuple(plain(r[c]) for c in cols) for r in spark_df.collect())


def oracle_rows(folder, sql):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(sql)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(rel.columns), sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
