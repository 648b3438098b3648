"""Holds queries against their SQL in DuckDB, as rows: columns by name, floats to nine digits."""

import glob
import os


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def cell(x):
    return "null" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = normal(df.collect(), df.columns), normal(got.fetchall(), columns)
    assert len(mine) == len(theirs)
    assert mine == theirs
