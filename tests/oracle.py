"""Running a registered query in Spark and its SQL in DuckDB, and comparing the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 9)
    return value


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    """Column names and rows, both in a canonical order."""
    names = sorted(frame.columns)
    data = [tuple(_plain(v) for v in row) for row in frame[names].astype(object).where(
        frame[names].notna(), None).itertuples(index=False, name=None)]
    return names, sorted(data, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def spark_rows(df):
    names = sorted(df.columns)
    data = [tuple(_plain(v) for v in row) for row in df.select(*names).collect()]
    return names, sorted(data, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def duck_rows(con, sql: str):
    relation = con.sql(sql)
    order = sorted(range(len(relation.columns)), key=lambda i: relation.columns[i])
    data = [tuple(_plain(row[i]) for i in order) for row in relation.fetchall()]
    return sorted(relation.columns), sorted(
        data, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
