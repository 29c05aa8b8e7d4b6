"""Comparison of a query's rows with its SQL on DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    return str(v)


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(map(value, r)) for r in df.itertuples(index=False))


def check(spark, c, sf, query, sql):
    mine, other = query(spark, sf).toPandas(), c.execute(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
