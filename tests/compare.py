"""Compare a registered query with its SQL in DuckDB, rows as multisets."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


def differences(frame, connection, sql: str) -> str | None:
    """What differs, or None."""
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    wanted = rows_of(columns, cursor.fetchall())
    got = rows_of(frame.columns, frame.collect())
    if wanted == got:
        return None
    return (
        f"{sum(got.values())} rows, wanted {sum(wanted.values())}\n"
        f"only here: {list((got - wanted).items())[:3]}\nonly wanted: {list((wanted - got).items())[:3]}"
    )
