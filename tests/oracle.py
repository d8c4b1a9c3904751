"""Runs SQL on the driver's tables and compares rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def same(frame, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    left, right = frame.toPandas(), con.sql(sql).df()
    names = sorted(left.columns)
    assert names == sorted(right.columns)
    rows = lambda p: sorted(map(tuple, p[names].astype(str).to_numpy().tolist()))
    assert rows(left) == rows(right)
