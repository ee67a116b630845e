"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares rows."""

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf_dir, con=None):
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    rel = (con or duck(sf_dir)).execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    assert sorted(df.columns) == sorted(names), (name, sorted(df.columns), sorted(names))
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    assert len(a) == len(b), (name, len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (name, sorted(names), x, y)
    return len(a)
