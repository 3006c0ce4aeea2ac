"""Streams against the batch result over several runs, repeated batches, and what a batch reads."""

import os
import random
from datetime import date, timedelta
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from deltion.operators.monitor import archive_visible
from deltion.streaming import incremental as inc
from deltion.streaming.tables import Folder, MergedLog, VersionedParts, numbers

SCHEMA = "key string, at timestamp"


def _land(spark, folder, n, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(folder, f"part{n}"))


def _stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


@pytest.fixture
def places(tmp_path):
    (tmp_path / "landed").mkdir()
    return str(tmp_path / "landed"), str(tmp_path / "out")


def test_notify_once_over_runs(spark, places):
    folder, ledger = places
    _land(spark, folder, 1, [("a", dt(2024, 1, 1)), ("a", dt(2024, 1, 2)), ("b", dt(2024, 1, 2)), (None, dt(2024, 1, 1))])
    inc.notify_once(_stream(spark, folder), ["key"], ledger)
    _land(spark, folder, 2, [("a", dt(2024, 2, 1)), ("c", dt(2024, 2, 1)), ("late", dt(2020, 1, 1)), (None, dt(2024, 3, 1))])
    inc.notify_once(_stream(spark, folder), ["key"], ledger)
    inc.notify_once(_stream(spark, folder), ["key"], ledger)
    assert sorted(str(r.key) for r in spark.read.parquet(ledger).collect()) == ["None", "a", "b", "c", "late"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_first_seen_log_stays_short(spark, places):
    folder, base = places
    r, rows = random.Random(1), []
    for n in range(9):
        new = [(r.choice("abcdef"), dt(2024, 1, 1) + timedelta(days=r.randint(0, 60))) for _ in range(4)]
        rows += new
        _land(spark, folder, n, new)
        inc.stamp_first_seen(_stream(spark, folder), ["key"], "at", base, every=3)
    schema = inc.first_seen_stream(spark.createDataFrame(rows, SCHEMA), ["key"], "at").schema
    got = {x.key: (x.first_seen, x.last_seen) for x in inc.read_first_seen(spark, ["key"], base, schema).collect()}
    assert got == {k: (min(t for x, t in rows if x == k), max(t for x, t in rows if x == k)) for k in {x for x, _ in rows}}
    log = inc.first_seen_log(spark, schema, ["key"], base, 3)
    assert len(log.paths(log.commits.last())) <= 4 and len(log.folder.names()) <= 10


def test_repeated_and_unfinished_batches_of_a_log(spark, places):
    _, base = places
    log = MergedLog(spark, base, spark.createDataFrame([], "k string, n long").schema, lambda d: d.groupBy("k").agg(F.max("n").alias("n")), every=2)
    df = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    for n in range(5):
        log.append(df(("a", n), (f"k{n}", n)), n)
        log.append(df(("a", n), (f"k{n}", n)), n)
    df(("half", 9)).write.parquet(f"{base}/batch=5")  # a batch that has not ended
    assert {r.k: r.n for r in log.read().collect()} == {"a": 4, **{f"k{n}": n for n in range(5)}}


def test_parts_read_what_a_batch_touches(spark, places):
    _, base = places
    schema = spark.createDataFrame([], "k long, v string").schema
    table = VersionedParts(spark, base, schema, F.col("k") % 4)
    df = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    table.write(df(*[(k, "old") for k in range(8)]), 0)
    table.commit([], 0)
    for n in range(1, 6):
        batch = df((1, f"v{n}"))
        parts = table.parts_of(batch)
        assert parts == ["1"]
        before = table.read(parts, before=n)
        assert {f.split("/part=")[1].split("/")[0] for f in before.inputFiles()} == {"1"}
        for _ in range(2):
            table.write(before.where("k != 1").unionByName(batch), n)
        table.commit(parts, n)
    table.write(df((2, "half")), 6)  # written, but the batch has not ended
    assert {r.k: r.v for r in table.read().collect()} == {**{k: "old" for k in range(8)}, 1: "v5"}
    assert all(len(numbers(Folder(spark, base).names(f"part={p}"), "version")) <= 2 for p in range(4))


def test_window_over_runs_equals_the_batch_operator(spark, places):
    folder, base = places
    schema, r, rows = "key long, day date, status string", random.Random(4), []
    for n in range(7):
        new = [(n * 100 + i, None if r.random() < 0.1 else date(2024, 1, 1) + timedelta(days=8 * n + r.randint(-40, 6)), r.choice(["VISIBLE", "VISIBLE", "REJECTED"])) for i in range(12)]
        rows += new if n != 3 else []
        _land(spark, folder, n, new if n != 3 else [], schema)
        inc.archive_stream(_stream(spark, folder, schema), "day", base)
        today = max(d for _, d, _ in rows if d)
        want = archive_visible(spark.createDataFrame(rows, schema), "day", F.lit(today))
        got = inc.read_window(spark, base, spark.createDataFrame([], schema).schema, "day")
        assert sorted(map(str, got.select("key", "day", "status").collect())) == sorted(map(str, want.select("key", "day", "status").collect()))
    assert {x.archived_in is not None for x in got.where("status = 'ARCHIVED'").collect()} == {True}


def test_source_state_over_runs(spark, places):
    folder, base = places
    initial = spark.createDataFrame([("s1", "old", "d0", "d0", "CHANGED", None)], "source_id string, fingerprint string, last_changed_at string, last_checked_at string, last_status string, last_error string")
    schema = "source_id string, seq long, fingerprint string, reachable boolean, requires_identifier boolean, error string, last_checked_at string"
    for n, rows in enumerate([[("s1", 1, "old", True, False, None, "d1"), ("s2", 2, "x", True, False, None, "d1")], [("s2", 3, None, False, False, "timeout", "d2")], [("s2", 4, "y", True, False, None, "d3"), ("s3", 5, "z", True, False, None, "d3")]]):
        _land(spark, folder, n, rows, schema)
        inc.preflight_batches(_stream(spark, folder, schema), base, initial)
        got = {r.source_id: (r.fingerprint, r.last_status, r.last_changed_at) for r in inc.last_state(spark, base, initial.schema).collect()}
        if n == 1:
            assert got["s2"] == ("x", "ERROR", "d1")
    assert got == {"s1": ("old", "SKIPPED_UNCHANGED", "d0"), "s2": ("y", "CHANGED", "d3"), "s3": ("z", "CHANGED", "d3")}
