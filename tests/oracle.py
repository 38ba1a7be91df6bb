"""Rows of a query and of its DuckDB SQL, in one form."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def _norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf=SF):
    df = query(spark, sf)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = df.select(*names).collect()
    assert _norm([tuple(r) for r in got], names) == _norm(want.fetchall(), names)
