"""Holds a query's rows against its SQL on the smallest tables."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def shown(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    return str(v) if not isinstance(v, int) else f"{v:.6f}"


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(shown, r)) for r in df[cols].astype(object).itertuples(index=False))


def assert_same(spark, name: str, query, sql: str, sf: str = SF) -> None:
    want, got = rows(connection(sf).execute(sql).df()), rows(query(spark, sf).toPandas())
    assert got[0] == want[0], name
    assert len(got[1]) == len(want[1]), name
    assert got[1] == want[1], name
