"""Runs a query in Spark and its SQL in DuckDB and compares all rows."""

import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def sql_rows(c, sql):
    found = c.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    return names, sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
