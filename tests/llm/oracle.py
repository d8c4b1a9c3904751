"""Runs a registered query and its SQL on the same tables and compares the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """A value as both sides show it: no kind of null differs from another, nor a whole number from itself held as a float beside nulls."""
    value = value.tolist() if hasattr(value, "tolist") else value
    if value is None or str(value) in ("nan", "<NA>", "NaT"):
        return "null"
    return str(int(value) if isinstance(value, float) and value.is_integer() else value)


def same(frame, sql: str, sf_dir: str) -> None:
    left, right = frame.toPandas(), connect(sf_dir).sql(sql).df()
    names = sorted(left.columns)
    assert names == sorted(right.columns)
    rows = lambda p: sorted(tuple(plain(x) for x in row) for row in p[names].astype(object).to_numpy().tolist())
    assert rows(left) == rows(right)
