"""Compare a Spark result with DuckDB's, as sorted rows of normalised values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def assert_matches(spark_df, sf_dir: str, sql: str):
    (names, got), (duck_names, want) = rows_of(spark_df), duck(sf_dir, sql)
    assert names == duck_names
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b
