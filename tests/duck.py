"""DuckDB over the given tables, and a comparison of rows that heeds neither order nor number types."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, bool) or hasattr(value, "dtype") and value.dtype == bool:
        return bool(value)
    if hasattr(value, "item"):
        value = value.item()
    return round(float(value), 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def assert_same(df, sql, sf_dir):
    left, right = rows(df.toPandas()), rows(connect(sf_dir).execute(sql).df())
    assert left[0] == right[0]
    assert len(left[1]) == len(right[1])
    different = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    assert not different, different[:3]
