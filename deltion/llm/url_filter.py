"""Rules on urls by a sort-merge range join.

The canonical key of a url is its host with the labels reversed, so a rule's host and all its subdomains are one
interval of keys. Urls and rules are dealt into ranges of the key, a rule into every range that its interval meets, and
each range is swept once in sorted order: a stack holds the rules whose intervals contain the current key, nested as
the domains are, each level with its rules by path.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, A-Z lower-cased, and the path after it; both empty where there is no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column) -> Column:
    """`www.example.com` as `com\\x01example\\x01www\\x01`: the key of a domain is a prefix of its subdomains' keys, and of no others'.

    The separator inside a label is written as \\x02\\x03, and \\x02 as \\x02\\x02.
    """
    plain = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x02")), F.lit("\x01"), F.lit("\x02\x03"))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), "\x01"), F.lit("\x01"))


def after(key: str) -> str:
    """The smallest text that is above all keys that begin with this one (which ends with the separator)."""
    return key[:-1] + "\x02"


def range_bounds(keys: DataFrame, ranges: int, sample_rows: int) -> list[str]:
    """Borders that cut the keys into about equal ranges, from a sample of at most about `sample_rows` keys.

    They only decide which task sweeps a row, as in Spark's own range partitioning; no row is left out. The first 300
    characters of a key are enough for that.
    """
    keys = keys.select(F.substring("key", 1, 300).alias("key"))
    n = keys.count()
    sampled = keys if n <= sample_rows else keys.sample(fraction=sample_rows / n, seed=7)
    found = sorted(r[0] for r in sampled.collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def apply_rules(urls: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url", ranges: int | None = None, sample_rows: int = 20_000) -> DataFrame:
    """Judge every url by the longest rule that fits it.

    `rules` has verdict, host and path. A rule fits its host and all subdomains if the url's path starts with its path;
    of those that fit, the one with the longest host and path together wins, then the one with the longer host, then
    block before allow. Returns the id, host, path, rule (`host` + `path`, null if none fits) and verdict (`default` if
    none fits). Null urls and urls without `://` have an empty host and path, which no rule with a host fits; repeated rows
    and null ids are kept; rules without a host or verdict are left out; an empty rule table leaves all to the default.

    A url's place also depends on a hash of its id, so equal urls, or a host with a third of all rows, spread over many
    ranges. Rules are a second input of the same shuffle, not a broadcast: a rule goes to the ranges its interval meets.
    """
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_column))
    id_type = urls.schema[id_column].dataType.simpleString()
    rows = urls.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", F.concat(canonical(F.col("host")), F.lit("\x00"), F.hex(F.xxhash64("id"))))
    bounds = range_bounds(rows.select("key"), ranges, sample_rows)

    def place(batches):
        for batch in batches:
            keys = batch.column(3).to_pylist()
            at = pa.array([bisect_right(bounds, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([at, *batch.columns], names=["range", "id", "host", "path", "key"])

    def deal(batches):
        for batch in batches:
            out = {n: [] for n in ("range", "host", "path", "key", "verdict")}
            for host, path, key, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(bisect_right(bounds, key), bisect_left(bounds, after(key)) + 1):
                    for name, value in zip(out, (at, host, path, key, verdict), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("range", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("key", pa.string()), ("verdict", pa.string())]))

    placed = rows.mapInArrow(place, f"range int, id {id_type}, host string, path string, key string")
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null").distinct()
    dealt = clean.select("host", "path", canonical(F.col("host")).alias("key"), "verdict").mapInArrow(deal, "range int, host string, path string, key string, verdict string")
    both = placed.withColumn("verdict", F.lit(None).cast("string")).unionByName(dealt, allowMissingColumns=True)
    both = both.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "key", F.col("verdict").isNull())
    return both.select("range", "id", "host", "path", "key", "verdict").mapInArrow(sweep(default), f"`{id_column}` {id_type}, host string, path string, rule string, verdict string")


def sweep(default: str):
    """One pass over sorted rows; rules come before the urls whose keys they are a prefix of."""

    def work(batches):
        at, stack = None, []  # of (key, {path: (length of host and path, length of host, blocks, rule, verdict)}, lengths of the paths)
        for batch in batches:
            ids, rules, verdicts, keep = batch.column(1), [], [], []
            for i, (where, host, path, key, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True)):
                if where != at:
                    at, stack = where, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    rank = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
                    by_path, lengths = stack[-1][1:]
                    if path not in by_path or by_path[path] < rank:
                        by_path[path] = rank
                    if len(path) not in lengths:
                        lengths.append(len(path))
                    continue
                fits = [rank for _, by_path, lengths in stack for n in lengths if n <= len(path) and (rank := by_path.get(path[:n]))]
                best = max(fits) if fits else (None,) * 3 + (None, default)
                keep.append(i)
                rules.append(best[3])
                verdicts.append(best[4])
            kept = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(kept), batch.column(2).take(kept), batch.column(3).take(kept), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return work
