"""Compares a query with its SQL on DuckDB, as multisets of rows with columns by name."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*' if __import__('os').path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "is_finite"):
        return float(f"{float(v):.9g}")
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql, sf_dir):
    con = connect(sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = multiset(names, got.fetchall())
    assert sorted(df.columns) == sorted(names)
    have = multiset(df.columns, [tuple(r) for r in df.collect()])
    assert len(have) == len(want), (len(have), len(want))
    for a, b in zip(have, want):
        assert a == b, (a, b)
    return len(have)
