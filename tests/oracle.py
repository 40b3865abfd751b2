"""Compares a registered query with its SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(table: pa.Table) -> tuple[list[str], list[str], list[str]]:
    """Column names, types and sorted rows, columns ordered by name."""
    names = sorted(table.column_names)
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    return names, types, sorted(map(repr, zip(*columns, strict=True)))


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    """What differs first, or None."""
    names, types, rows = normal(spark_table)
    sql_names, sql_types, sql_rows = normal(sql_table)
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if types != sql_types:
        return "types " + ", ".join(
            f"{n}: {a} != {b}" for n, a, b in zip(names, types, sql_types, strict=True) if a != b
        )
    if len(rows) != len(sql_rows):
        return f"{len(rows)} rows != {len(sql_rows)}"
    wrong = [(a, b) for a, b in zip(rows, sql_rows, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(rows)} rows differ, e.g. {names}\n  {wrong[0][0]}\n  {wrong[0][1]}"
    return None
