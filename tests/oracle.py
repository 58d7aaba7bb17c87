"""Holds registered queries against their SQL, as the driver does."""

import datetime
import glob
import os
from collections import Counter

import duckdb

FOLDER = "/root/testdata/sf0.001"


def database(folder=FOLDER):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return round(value, 9)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def difference(spark, con, query, sql, folder=FOLDER):
    frame = query(spark, folder)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in frame.columns)) for r in found.fetchall())
    got = Counter(repr(tuple(map(plain, r))) for r in frame.collect())
    return list((got - want).items())[:3], list((want - got).items())[:3]
