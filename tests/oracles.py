"""Runs registered queries beside their DuckDB SQL and compares rows as multisets."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, int) and not isinstance(x, bool):
        return int(x)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted((repr(tuple(plain(r[k]) for k in order)) for r in data))


def compare(spark, connection, name, f, sql, sf_dir) -> str:
    """Empty if equal, else what differs first."""
    df = f(spark, sf_dir)
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = connection.sql(sql)
    wanted_names, wanted = rows(r.columns, r.fetchall())
    if names != wanted_names:
        return f"{name}: columns {names} for {wanted_names}"
    if len(got) != len(wanted):
        return f"{name}: {len(got)} rows for {len(wanted)}; first {next((x for x in zip(got, wanted) if x[0] != x[1]), (got[:1], wanted[:1]))}"[:700]
    for a, b in zip(got, wanted):
        if a != b:
            return f"{name}: {a} for {b}"[:700]
    return ""
