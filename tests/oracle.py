"""Run a query and its SQL on the same tables and compare the rows."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _key(row):
    return tuple("\0" if v is None else repr(round(v, 7) + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v) for v in row)


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(folder)):
        name = f.split(".")[0]
        at = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}'")
    return c


def assert_same(spark, query, sql, folder=SF):
    got = query(spark, folder)
    cols = sorted(got.columns)
    rel = connect(folder).sql(sql)
    assert sorted(rel.columns) == cols, (cols, sorted(rel.columns))
    want = rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()
    have = [tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()]
    a, b = sorted(map(_key, have)), sorted(map(_key, want))
    assert len(a) == len(b), (len(a), len(b))
    off = [(x, y) for x, y in zip(a, b) if x != y]
    assert not off, (len(off), off[:3])
    return len(a)
