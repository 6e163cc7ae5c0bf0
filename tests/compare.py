"""Runs every query with SQL beside DuckDB and compares rows."""

import math
import os

import duckdb


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in found), key=key)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b


def tables(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    return con


def differ(spark, con, query, sql, sf_dir):
    """What differs between a query and its SQL, empty if nothing."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    done = con.execute(sql)
    want = rows([c[0] for c in done.description], done.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, not {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if not all(map(same, a, b))]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
