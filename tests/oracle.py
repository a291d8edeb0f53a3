"""Runs a query in Spark and in DuckDB and compares the rows."""

import os

import duckdb


def norm(value):
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def rows_of(df):
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in df.collect())


def duck_rows(folder, sql):
    con = duckdb.connect()
    for file in os.listdir(folder):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(norm(r[i]) for i in order) for r in found.fetchall())


def compare(spark, query, sql, folder):
    df = query(spark, folder)
    names, expected = duck_rows(folder, sql)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected
