"""Comparison of a query's rows with those of its SQL, as multisets of values by column name."""

import datetime
from collections import Counter
from pathlib import Path

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


def _plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return repr(v) if isinstance(v, float) else v


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def assert_same(df, sql, sf_dir):
    con = connect(sf_dir)
    found = con.execute(sql)
    names, kinds = [d[0] for d in found.description], [str(d[1]) for d in found.description]
    assert sorted(names) == sorted(df.columns)
    ours = dict(df.dtypes)
    assert {n: KINDS[ours[n]] for n in names} == dict(zip(names, kinds, strict=True))
    order = sorted(names)
    want = Counter(tuple(_plain(r[names.index(n)]) for n in order) for r in found.fetchall())
    got = Counter(tuple(_plain(r[n]) for n in order) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
