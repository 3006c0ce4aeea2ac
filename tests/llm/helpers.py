"""Registered queries of the subpackage run over a small folder of tables."""

from __future__ import annotations

import os

from tests.oracle_check import compare, connect

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string",
    "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
}


def write(spark, folder, **rows) -> str:
    """The given rows as tables; each table also gets a column with a name that operators use inside."""
    for name, schema in TABLES.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        df.selectExpr("*", "'x' AS id", "1 AS n", "'y' AS key", "2 AS host").write.parquet(os.path.join(str(folder), f"{name}.parquet"))
    return str(folder)


def write_vectors(spark, folder, rows) -> str:
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.selectExpr("*", "'x' AS v", "1 AS cluster", "'y' AS state").write.parquet(os.path.join(str(folder), "embeddings.parquet"))
    return str(folder)


def against_sql(spark, folder, name) -> list[str]:
    from deltion.llm.queries import QUERIES, SQL

    con = connect_folder(folder)
    return [p for p in compare(QUERIES[name](spark, folder), con, SQL[name]) if p != "no rows"]


def connect_folder(folder):
    import duckdb

    if all(os.path.isfile(os.path.join(folder, f)) for f in os.listdir(folder)):
        return connect(folder)
    con = duckdb.connect()
    for name in sorted(f.removesuffix(".parquet") for f in os.listdir(folder)):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con
