"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

import glob
import math
import os

import duckdb


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return repr(float(v)) if type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in data), [columns[i] for i in order]


def compare(spark, fn, sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = fn(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows([c[0] for c in cur.description], cur.fetchall())
    assert mine[1] == theirs[1], (mine[1], theirs[1])
    assert len(mine[0]) == len(theirs[0]), (len(mine[0]), len(theirs[0]))
    diff = [(a, b) for a, b in zip(mine[0], theirs[0]) if a != b]
    assert not diff, (len(diff), diff[0])
    return len(mine[0])
