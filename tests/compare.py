"""Holds a query against its SQL as the driver does: columns by name, rows in any order."""

import math
import os


def duck(sf_dir, sql):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def differences(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names, data = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    a, b = rows(df.columns, df.collect()), rows(names, data)
    return [(x, y) for x, y in zip(a, b) if x != y][:3], len(a), len(b)
