"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "NULL" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.10g}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in rows)


def check(spark, name, query, sql):
    """The query runs; if it has SQL, both give the same rows."""
    df = query(spark, DATA)
    got = _rows(df.columns, df.collect())
    if sql:
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        done = con.execute(sql)
        assert got == _rows([d[0] for d in done.description], done.fetchall()), name
