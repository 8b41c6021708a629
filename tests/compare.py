"""Holds a query's rows against those of its SQL in DuckDB: columns by name, rows as a multiset, floats rounded."""

import datetime
import math
from collections import Counter
from decimal import Decimal

import duckdb

from tessella.session import TABLES


def database(folder):
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return found


def plain(value):
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(map(plain, value.values()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value.isoformat() if isinstance(value, datetime.date) else value


def rows_and_columns(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(frame, con, sql):
    """What differs, in words; empty if nothing does."""
    found = con.execute(sql)
    want = rows_and_columns([c[0] for c in found.description], found.fetchall())
    got = rows_and_columns(frame.columns, frame.collect())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    return "" if got == want else f"only Spark: {list((got[1] - want[1]).items())[:3]}; only SQL: {list((want[1] - got[1]).items())[:3]}"
