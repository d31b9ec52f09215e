"""Holds a query against its oracle on the driver tables."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9) if math.isfinite(value) else str(value)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def assert_same(spark, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    assert [x.replace(".0,", ",").replace(".0]", "]") for x in got] == [x.replace(".0,", ",").replace(".0]", "]") for x in want]
