"""Runs a query and its oracle on the same parquet files and compares all rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return str(value) if hasattr(value, "isoformat") else value


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def oracle_rows(sql, sf_dir=SMALL):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return [got.columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
