"""Comparing a Spark result with the SQL counterpart, order aside."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and a statement: columns, types, row count, values."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = {d[0]: str(d[1]) for d in got.description}
    expected = rows_of(names, got.fetchall())
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if _KINDS.get(kind, kind) != kinds[name]:
            found.append(f"type of {name}: {kind} != {kinds[name]}")
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        found.append(f"rows {len(actual)} != {len(expected)}")
    if actual != expected:
        extra = [r for r in actual if r not in set(expected)][:2]
        lacking = [r for r in expected if r not in set(actual)][:2]
        found.append(f"columns {sorted(names)}\n  only in spark {extra}\n  only in sql   {lacking}")
    return found
