"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def cell(value):
    """One spelling per value; types stay apart, except for the widths of integers."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return f"bool:{value}"
    if isinstance(value, int):
        return f"int:{value}"
    if isinstance(value, float):
        return "float:nan" if math.isnan(value) else f"float:{value + 0.0:.12g}"
    if isinstance(value, decimal.Decimal):
        return f"decimal:{value}"
    if isinstance(value, datetime.datetime):
        return f"time:{value.isoformat()}"
    if isinstance(value, datetime.date):
        return f"date:{value.isoformat()}"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def differences(frame, con, sql):
    """("columns" | "count" | "rows", detail) of the first mismatch, or None."""
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(frame.columns):
        return "columns", (sorted(names), sorted(frame.columns))
    expected = rows_of(names, result.fetchall())
    found = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    if len(expected) != len(found):
        return "count", (len(expected), len(found))
    for left, right in zip(expected, found):
        if left != right:
            return "rows", (left, right)
    return None
