"""Structured Streaming forms of the incremental operators.

Streams read landed files. State lives in Spark's state store under a checkpoint in the shared folder, or in tables there
(`streaming.tables`) that a batch writes under its own number, so a lost executor, a restart or a repeated batch gives the
same result. The work of a batch follows its own rows, not what earlier batches have left.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deltion.session import new_path
from deltion.streaming.tables import MergedLog, VersionedParts, numbers

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_landed(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream over landed parquet files of one table."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Drain what has landed into parquet, then stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(stream: DataFrame, write, base: str, mode: str = "append") -> None:
    """Drain what has landed through `write(batch, batch_id)`, then stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", base + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings; a stream keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_ARCHIVED = StructType().add("archived_in", "long")

# --- J6 first seen ---------------------------------------------------------------------------


def first_seen_stream(events: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """First and last time per key as a running aggregate (update mode)."""
    return events.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def first_seen_log(spark: SparkSession, schema: StructType, keys: Sequence[str], base: str, every: int = 10) -> MergedLog:
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))

    return MergedLog(spark, base, schema, merge, every)


def stamp_first_seen(events: DataFrame, keys: Sequence[str], at: str, base: str, every: int = 10) -> None:
    """Keep the running result: each batch writes the keys it changed; every `every` batches the log is merged."""
    stream = first_seen_stream(events, keys, at)
    schema = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        first_seen_log(batch.sparkSession, schema, keys, base, every).append(batch, batch_id)

    run_batches(stream, write, base, "update")


def read_first_seen(spark: SparkSession, keys: Sequence[str], base: str, schema: StructType) -> DataFrame:
    """The table the batches add up to; reads one snapshot and a bounded number of batches."""
    return first_seen_log(spark, schema, keys, base).read()


def stamped_at(own: Column, stored: Column, now: Column) -> Column:
    """Own time, else the stored first time, else now."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(stored, F.lit("")), now)


# --- J7 notify once --------------------------------------------------------------------------


def notify_once(stream: DataFrame, keys: Sequence[str], ledger: str) -> None:
    """Each key is handed out once over all runs, however late its event comes.

    The keys handed out are in the state store (RocksDB, changes written to the checkpoint), where a batch looks up its own
    keys only. There is no watermark, so no key is forgotten and none is too late. `ledger` gets the rows that were handed out;
    Spark's file sink commits each batch once.
    """
    with settings(stream.sparkSession, STATE_STORE):
        run_available(stream.dropDuplicates(list(keys)), ledger)


# --- J3 source state -------------------------------------------------------------------------


def preflight_table(spark: SparkSession, base: str, schema: StructType, buckets: int = 64) -> VersionedParts:
    """Source state in hash buckets of the source id."""
    return VersionedParts(spark, base, schema, F.pmod(F.xxhash64("source_id"), F.lit(buckets)))


def preflight_batches(checks: DataFrame, base: str, initial: DataFrame, buckets: int = 64) -> None:
    """Fold each batch of checks into the source state table; a batch reads and writes the buckets of its sources only.

    Inside a batch the last check of a source counts, and the last good fingerprint survives an error.
    """
    from deltion.operators.monitor import persist_preflight
    from deltion.operators.ranking import latest_per_key

    schema = initial.schema
    table = preflight_table(checks.sparkSession, base, schema, buckets)
    if table.commits.last() is None:
        table.write(initial, -1)
        table.commit([], -1)

    def write(batch: DataFrame, batch_id: int) -> None:
        table = preflight_table(batch.sparkSession, base, schema, buckets)
        parts = table.parts_of(batch)
        table.write(persist_preflight(latest_per_key(batch, "source_id", "seq"), table.read(parts, before=batch_id)), batch_id)
        table.commit(parts, batch_id)

    run_batches(checks, write, base)


def last_state(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """State after the last whole batch."""
    return preflight_table(spark, base, schema).read()


# --- J5 visible window -----------------------------------------------------------------------


def window_table(spark: SparkSession, base: str, schema: StructType, day: str) -> VersionedParts:
    """Rows by day (rows without a day are a part of their own)."""
    return VersionedParts(spark, base, schema, F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit("none")))


def archive_stream(rows: DataFrame, day: str, base: str, days: int = 15) -> None:
    """A table of all rows landed, in which VISIBLE ones turn ARCHIVED once their day has left the window.

    The window ends at the newest day seen so far. A batch writes the days of its own rows, and the days that leave the window
    with it; a late row is archived on arrival, none is dropped. `archived_in` is the batch that archived a row (null
    for rows that it did not).
    """
    schema = StructType([*rows.schema.fields, *_ARCHIVED.fields])

    def write(batch: DataFrame, batch_id: int) -> None:
        from deltion.operators.monitor import archive_visible

        table = window_table(batch.sparkSession, base, schema, day)
        stored = [p for p in table.all_parts() if p != "none"]
        own = table.parts_of(batch)
        if not own:
            table.commit([], batch_id)
            return
        before = max((p for p in stored if _known(table, p, batch_id)), default=None)
        newest = max((p for p in (*own, before) if p and p != "none"), default=None)
        parts = set(own)
        parts |= {p for p in stored if _cut(before, days) <= p < _cut(newest, days)}
        today = F.to_date(F.lit(newest), "yyyyMMdd")
        merged = table.read(sorted(parts), before=batch_id).unionByName(batch.withColumn("archived_in", F.lit(None).cast("long")))
        out = archive_visible(merged, day, today, days)
        out = out.withColumn("archived_in", F.when(F.col("archived_now"), F.lit(batch_id).cast("long")).otherwise(F.col("archived_in")))
        table.write(out, batch_id)
        table.commit(sorted(parts), batch_id)

    run_batches(rows, write, base)


def _cut(newest: str | None, days: int) -> str:
    """The first day that is still in a window which ends at `newest`; no day is before that of an empty table."""
    return (datetime.strptime(newest, "%Y%m%d") - timedelta(days - 1)).strftime("%Y%m%d") if newest else ""


def _known(table: VersionedParts, part: str, before: int) -> bool:
    """Whether a batch before this one has written the part."""
    return any(v < before for v in numbers(table.folder.names(f"part={part}"), "version"))


def read_window(spark: SparkSession, base: str, schema: StructType, day: str) -> DataFrame:
    """All rows landed with their status, and the batch that archived them."""
    return window_table(spark, base, StructType([*schema.fields, *_ARCHIVED.fields]), day).read()


def visible_window_stream(records: DataFrame, day: str, days: int, delay: str = "0 seconds") -> DataFrame:
    """Counts of records per day that have left the window: a day closes once the watermark (the
    newest day seen minus `days` - 1) has passed it."""
    stamped = records.withWatermark(day, f"{days - 1} days")
    return stamped.groupBy(F.window(day, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("records")).select(F.col("w.start").alias("day"), "records")


def drain(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what has landed and read its output."""
    out = new_path(spark, label)
    run_available(stream, out)
    return spark.read.parquet(out)
