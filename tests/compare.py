"""Rows of a query and of its SQL on the same tables."""

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(df, sql: str, folder: str = DATA) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want, got = con.sql(sql).df(), df.toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda f: sorted(map(tuple, f[cols].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)
