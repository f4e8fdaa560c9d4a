"""Runs a query's SQL in DuckDB and compares whole results, order aside."""

import decimal
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, decimal.Decimal) and value == int(value):
        return int(value)
    if isinstance(value, list):
        return tuple(map(plain, value))
    if getattr(value, "tzinfo", None):
        return value.replace(tzinfo=None)
    return value


def compare(con, df, sql):
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    want = Counter(tuple(map(plain, r)) for r in found.fetchall())
    got = Counter(tuple(map(plain, r)) for r in df.select(*found.columns).collect())
    assert got == want
