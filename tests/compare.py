"""Rows of Spark and DuckDB in a comparable form."""

import datetime
import decimal


def plain(value, inside=False):
    if isinstance(value, decimal.Decimal) and inside:  # in a list not the same as an equal float
        return f"decimal {value}"
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, list | tuple):
        return tuple(plain(v, True) for v in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return bytes(value) if isinstance(value, bytearray) else str(value)


def assert_same(df, con, sql):
    names = sorted(df.columns)
    found = sorted(tuple(plain(row[c]) for c in names) for row in df.collect())
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == names
    wanted = sorted(tuple(plain(dict(zip(columns, row, strict=True))[c]) for c in names) for row in answer.fetchall())
    assert found == wanted
