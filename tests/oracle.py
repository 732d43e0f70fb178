"""Compares a query with the SQL it is held against, by column names, types and rows."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{sf_dir}/{f}'")
    return con


def rows(table):
    names = sorted(table.schema.names)
    columns = [table.column(n).to_pylist() for n in names]
    shown = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(shown, r)) for r in zip(*columns))


def same(spark, con, sf_dir, query, sql):
    got, want = query(spark, sf_dir).toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(got.schema.names) == sorted(want.schema.names)
    assert rows(got) == rows(want)
