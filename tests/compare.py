"""Query against its SQL: columns, and rows as a multiset, numbers to nine digits."""

import datetime
import math
import os
from pathlib import Path

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(FOLDER).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same(spark, query, sql):
    df, result = query(spark, FOLDER), connect().execute(sql)
    names = sorted(df.columns)
    theirs = [x[0] for x in result.description]
    assert sorted(theirs) == names
    want = sorted(repr([plain(dict(zip(theirs, row, strict=True))[n]) for n in names]) for row in result.fetchall())
    assert sorted(repr([plain(r[n]) for n in names]) for r in df.collect()) == want
