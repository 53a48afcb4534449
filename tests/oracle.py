"""Rows of a query and of its SQL, made comparable."""

import glob
import os

import duckdb


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(_plain(x) for x in r) for r in plain.values.tolist()), key=str)


def _plain(x):
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def duck(sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con.execute(sql).df()


def assert_same(spark_frame, sql, folder):
    a, b = spark_frame.toPandas(), duck(sql, folder)
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert rows(a, columns) == rows(b, columns)
