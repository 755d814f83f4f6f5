"""Files and sidecars that are listed more than once, as names of documents 210,000 apart are equal."""

import os

import duckdb
import pytest

from siftwork.catalog import ORACLES, QUERIES
from tests.compare import SMALL, TABLES, oracle_rows, rows_of


@pytest.fixture(scope="module")
def listed_twice(tmp_path_factory):
    at = tmp_path_factory.mktemp("listed_twice")
    for t in TABLES:
        if t not in ("documents", "labels"):
            os.symlink(f"{SMALL}/{t}.parquet", at / f"{t}.parquet")
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE ((doc_id + k * 210000)::BIGINT AS doc_id) FROM '{SMALL}/documents.parquet', range(2) r(k) WHERE doc_id IN (3, 10)) TO '{at}/documents.parquet'")
    rows = "(VALUES (3, 1), (210003, 1), (10, 0), (210010, 0)) v(id, good)"
    con.sql(f"COPY (SELECT id::BIGINT AS doc_id, good AS quality, 0 AS toxic FROM {rows}) TO '{at}/labels.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["sidecar_cross_part", "sidecar_same_folder"])
def test_a_hit_is_one_row(spark, listed_twice, name):
    got = rows_of(QUERIES[name](spark, listed_twice))
    assert len(got[1]) == 1
    assert got == oracle_rows(ORACLES[name], listed_twice)


@pytest.fixture(scope="module")
def without_source(tmp_path_factory):
    at = tmp_path_factory.mktemp("without_source")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{SMALL}/{t}.parquet", at / f"{t}.parquet")
    gaps = "CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang, CASE WHEN doc_id % 3 <> 0 THEN source END AS source"
    duckdb.sql(f"COPY (SELECT * REPLACE ({gaps}) FROM '{SMALL}/documents.parquet') TO '{at}/documents.parquet'")
    return str(at)


@pytest.mark.parametrize("name", ["sidecar_same_folder", "sidecar_cross_part"])
def test_a_file_without_language_or_source_keeps_its_path(spark, without_source, name):
    got = rows_of(QUERIES[name](spark, without_source))
    assert any(row[got[0].index("path")].startswith("/") for row in got[1])
    assert got == oracle_rows(ORACLES[name], without_source)
