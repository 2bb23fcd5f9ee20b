"""Compares a query with its SQL over the same tables, as the driver does."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def by_sql(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def differences(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names, found = by_sql(sf_dir, sql)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    ours, theirs = rows(df.columns, df.collect()), rows(names, found)
    if ours == theirs:
        return len(ours), []
    extra, missing = [r for r in ours if r not in set(theirs)], [r for r in theirs if r not in set(ours)]
    return len(ours), [f"{len(ours)} rows, {len(theirs)} by SQL", *(f"only Spark: {r}" for r in extra[:3]), *(f"only SQL: {r}" for r in missing[:3])] or ["order"]
