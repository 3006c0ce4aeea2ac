"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir` of the session.

    Only a session on one machine that names none (tests) gets a new folder; a cluster must name its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that later steps read more than once to the shared folder and read it back.

    The table survives lost executors, and the steps after it do not repeat the work before it.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that `settle` wrote, once everything made of them is written itself and no later step reads them.

    The driver collects its garbage then: shuffle files of the steps before would stay until it happens to.
    """
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {os.path.dirname(file) for file in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def marked(hashes: DataFrame, most: int = 1 << 29):
    """A test for arrays of 64-bit hashes: true for all hashes of the frame (its one column) and for few others, of 17 one or less.

    It is a map of 16 to 32 bits for each row, 64 MB at most, made in parts by the tasks; beyond that more others pass.
    """
    import numpy as np
    import pyarrow as pa

    part, spark = 1 << 19, hashes.sparkSession
    hashes = hashes.select(F.col(hashes.columns[0]).alias("hash"))
    size = min(most, 1 << max(12, (16 * hashes.count()).bit_length()))

    def work(batches):
        parts = {}
        for batch in batches:
            at = batch.column(0).to_numpy() & (size - 1)
            for k in np.unique(at // part).tolist():
                bits = parts.setdefault(k, np.zeros(min(part, size) // 8, np.uint8))
                here = at[at // part == k] % part
                np.bitwise_or.at(bits, here >> 3, np.uint8(1) << (here & 7).astype(np.uint8))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    dealt = hashes.repartition(F.expr(f"(hash & {size - 1}) div {part}"))
    bits = np.zeros(size // 8, np.uint8)
    for k, found in dealt.mapInArrow(lean(work), "part long, bits binary").collect():
        bits[k * part // 8 :][: len(found)] |= np.frombuffer(found, np.uint8)
    held = spark.sparkContext.broadcast(bits)

    def test(values):
        at = values & (size - 1)
        return (held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return test


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model may learn from; a null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the position (from 0) of each row in its group by `order`, and, with keys, the size of the group as `<name>_of`.

    Rows are sorted by ranges over all tasks; a group may fill many of them, and equal rows, told apart by where they were
    read, too. Only the number of rows of a group in a task goes on to a window. The sorted rows are written once, so a
    task that is repeated finds the same numbers. Nulls come first and are a key like any other.
    """
    columns = df.columns
    rows = df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*keys, *order, "_salt").sortWithinPartitions(*keys, *order, "_salt").drop("_salt")
    rows = settle(rows.withColumns({"_task": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "numbered")
    counts = rows.groupBy("_task", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_from"))
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_task").alias("_at"), *(F.col(k).alias(f"_{k}_at") for k in keys), "_from", before.alias("_before"), F.sum("_n").over(group).alias(f"{name}_of"))
    same = F.col("_task") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_at"))
    return rows.join(counts, same).select(*columns, (F.col("_before") + F.col("_row") - F.col("_from")).alias(name), *([f"{name}_of"] if keys else []))


def free_name(columns: list[str], name: str) -> str:
    """The name, or the name and underscores, that none of the columns has (upper and lower case count as equal)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(work):
    """The same work on batches; at its end the memory that Arrow and malloc keep for later goes back, as workers live on between tasks."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim:
                trim(0)

    return run
