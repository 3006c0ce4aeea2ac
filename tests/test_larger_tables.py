"""Queries against their SQL over tables as they are at other sizes: higher keys, tables in several files."""

import os

import duckdb
import pytest

from deltion.catalog import load
from tests.oracle_check import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    """sf0.001 with orders whose ids have six to nine digits, and pages in a folder of two files."""
    folder, con = tmp_path_factory.mktemp("larger"), duckdb.connect()
    for file in os.listdir(FOLDER):
        if file not in ("orders.parquet", "pages.parquet"):
            (folder / file).symlink_to(f"{FOLDER}/{file}")
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    con.execute(f"COPY (SELECT o.* REPLACE (o_orderkey + shift AS o_orderkey) FROM '{FOLDER}/orders.parquet' o, (VALUES (0), (899000), (899999), (9899000), (99899000)) s(shift)) TO '{folder}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet'")
    (folder / "pages.parquet").mkdir()
    for part in (0, 1):
        con.execute(f"COPY (SELECT * FROM '{FOLDER}/pages.parquet' WHERE page_id % 2 = {part}) TO '{folder}/pages.parquet/part-{part}.parquet'")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["c25_registry_numeric_id", "i10_extract_ids", "a8_scan_files"])
def test_query_equals_sql(spark, larger, name):
    folder, con = larger
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]) == []
