"""Holds every registered query against its SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat(sep=" ") if hasattr(v, "isoformat") else v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, fn, sql: str, sf_dir: str, c: duckdb.DuckDBPyConnection) -> str:
    df = fn(spark, sf_dir)
    found = c.execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    got = rows_of(df.columns, df.collect())
    if got == want:
        return ""
    lost, more = [r for r in want[1] if r not in set(got[1])], [r for r in got[1] if r not in set(want[1])]
    return f"{got[0]} {want[0]} rows {len(got[1])} {len(want[1])} lost {lost[:3]} more {more[:3]}"
