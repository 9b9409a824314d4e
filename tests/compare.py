"""Run a Spark query and its SQL twin and compare rows, names and types."""

from __future__ import annotations

import os

import duckdb
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t):
        return "string"
    if pa.types.is_null(t):
        return "string"
    return str(t)


def rows_of(table: pa.Table) -> tuple[list[tuple[str, str]], list[tuple]]:
    names = sorted(table.column_names)
    table = table.select(names)
    kinds = [(n, _kind(table.schema.field(n).type)) for n in names]
    rows = list(zip(*(table.column(n).to_pylist() for n in names), strict=True)) if table.num_rows else []
    return kinds, sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs first."""
    left_kinds, left = rows_of(df.toArrow())
    right_kinds, right = rows_of(con.sql(sql).to_arrow_table())
    if left_kinds != right_kinds:
        return f"schema {left_kinds} != {right_kinds}"
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:1], [r for r in right if r not in set(left)][:1]
        return f"rows {len(left)} != {len(right)}: {str(extra)[:600]}"
    for a, b in zip(left, right, strict=True):
        if a != b:
            return f"{[n for n, _ in left_kinds]}: {str(a)[:300]} != {str(b)[:300]}"
    return None
