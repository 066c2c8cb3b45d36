"""Comparing a Spark result with what DuckDB gives: by names, rows and values, in any order."""

import math


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def assert_same(df, con, sql):
    got = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    mine = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    theirs = [tuple(_plain(dict(zip(got.columns, r))[c]) for c in columns) for r in got.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(mine, key=key) == sorted(theirs, key=key)
