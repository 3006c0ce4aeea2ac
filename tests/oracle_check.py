"""Run registered queries and their SQL side by side and compare whole results.

    python tests/oracle_check.py [name part ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


TIMES: list[float] = []


def connect(folder: str):
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return con


def compare(df, con, sql: str) -> list[str]:
    columns = sorted(df.columns)
    start = time.time()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    TIMES[:] = [time.time() - start]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    if sorted(names) != columns:
        return [f"columns {columns} != {sorted(names)}"]
    at = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in rows]
    problems = []
    if len(got) != len(want):
        problems.append(f"{len(got)} rows, expected {len(want)}")
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            problems.append(f"{dict(zip(columns, a))} != {dict(zip(columns, b))}")
            if len(problems) > 3:
                break
    if not want:
        problems.append("no rows")
    return problems


def main(parts: list[str]) -> int:
    from deltion.catalog import load
    from deltion.session import get_session

    queries, oracles = load()
    exact = [p for p in parts if p in queries]
    names = exact or [n for n in queries if not parts or any(n.startswith(p) for p in parts)]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(FOLDER), 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, FOLDER)
            problems = compare(df, con, oracles[name]) if name in oracles else ([] if df.count() else ["no rows"])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s spark {TIMES[0] if TIMES else 0:.1f}s {'' if name in oracles else '(rows only)'}", flush=True)
        for p in problems:
            print("     ", p[:900], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
