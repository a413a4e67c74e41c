"""Compare registered queries with their DuckDB SQL, as the driver does: rows, columns and values, in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data), sorted(columns)


def difference(df, con, sql):
    """None, or what differs first."""
    got, got_names = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want, want_names = rows(rel.columns, rel.fetchall())
    if got_names != want_names:
        return f"columns {got_names} {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} is not {w}"[:600]
    return None
