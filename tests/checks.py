"""Side-by-side comparison of a Spark query with its SQL check."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if hasattr(v, "isoformat") or isinstance(v, (list, tuple)) else v


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((x is None, type(x).__name__, x if x is not None else 0) for x in r)
    return [columns[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=key)


def same(df, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.execute(sql)
    want = ordered([d[0] for d in found.description], found.fetchall())
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == want
    return len(want[1])
