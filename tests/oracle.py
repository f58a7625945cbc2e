"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        path = f"{sf_dir}/{file}"
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.6g}" if math.isfinite(value) else str(value)
    return str([_plain(v) for v in value]) if isinstance(value, list) else str(value)


def rows_of(table):
    names = sorted(table.column_names)
    return sorted(tuple(_plain(row[n]) for n in names) for row in table.to_pylist())


def same(query, sql, spark, sf_dir, con):
    left, right = query(spark, sf_dir).toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(left.column_names) == sorted(right.column_names)
    assert rows_of(left) == rows_of(right)
