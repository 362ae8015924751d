"""Holds a query against its SQL on DuckDB, values and all."""

import glob
import os

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (not isinstance(value, (list, dict, tuple)) and not hasattr(value, "__len__") and pd.isna(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 9) if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck_rows(sql, sf_dir=SMALL):
    with duckdb.connect() as con:
        con.execute("set threads to 4")
        for path in glob.glob(f"{sf_dir}/*.parquet"):
            where = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{where}')")
        out = con.execute(sql)
        return rows_of([d[0] for d in out.description], out.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def compare(df, sql, sf_dir=SMALL):
    columns, got = spark_rows(df)
    wanted_columns, wanted = duck_rows(sql, sf_dir)
    assert columns == wanted_columns
    assert len(got) == len(wanted), (len(got), len(wanted))
    for a, b in zip(got, wanted):
        assert a == b, (a, b)
    return len(got)
