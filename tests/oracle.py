"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import os

import duckdb


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, data, query, sql):
    con = duckdb.connect()
    con.execute("SET temp_directory = '/tmp/duckdb-tests'; SET max_temp_directory_size = '1GB'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    df = query(spark, data)
    assert sorted(df.columns) == sorted(names)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(found.fetchall(), names)
