"""State tables (B*): every policy is `(target, source, keys) -> new target`.

Keys are unique in the target; the source is reduced to one row per key first. A new table is
returned; the caller writes it to a new path and swaps, or hands it to a catalog with MERGE.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion.operators.ranking import last_wins, prefer_then_latest

Pick = Callable[[str, Column, Column, Column], Column]


def _merge(target: DataFrame, source: DataFrame, keys: Sequence[str], pick: Pick) -> DataFrame:
    """Full outer join on the keys; `pick(column, old, new, arrived)` gives the value kept."""
    columns = [c for c in target.columns if c not in keys]
    types = dict(target.dtypes)
    new = [(F.col(c) if c in source.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns]
    t = target.select(*keys, F.struct(*columns).alias("_t"))
    s = source.select(*keys, F.struct(*new).alias("_s"))
    joined = t.join(s, list(keys), "full_outer")
    arrived = F.col("_s").isNotNull()
    return joined.select(*keys, *[pick(c, F.col("_t")[c], F.col("_s")[c], arrived).alias(c) for c in columns])


def upsert_replace(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """B1: insert, or overwrite every other column."""
    return _merge(target, source, keys, lambda c, old, new, arrived: F.when(arrived, new).otherwise(old))


def upsert_coalesce(target: DataFrame, source: DataFrame, keys: Sequence[str], always: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """B2: overwrite with values that are not null; `always` columns in any case, `keep` columns never once set."""

    def pick(c, old, new, arrived):
        if c in always:
            return F.when(arrived, new).otherwise(old)
        return F.coalesce(old, new) if c in keep else F.coalesce(new, old)

    return _merge(target, source, keys, pick)


def upsert_first_last_seen(target: DataFrame, source: DataFrame, keys: Sequence[str], first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """The first time stays, the last time moves."""
    return upsert_coalesce(target, source, keys, keep=[first], always=[last])


def seen_from_events(events: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """First and last time per key from raw events."""
    return events.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert only keys not yet present."""
    fresh = source.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def replace_slice(target: DataFrame, source: DataFrame, slice_keys: Sequence[str], slices: DataFrame | None = None) -> DataFrame:
    """Delete all rows of the touched slices, insert the new set."""
    touched = (slices if slices is not None else source).select(*slice_keys).distinct()
    return target.join(touched, list(slice_keys), "left_anti").unionByName(source.select(*target.columns))


def delete_stale_links(target: DataFrame, keep: DataFrame, touched: DataFrame, source: str, link: str) -> DataFrame:
    """For touched sources drop the edges that are not in the current keep set."""
    stale = target.join(touched.select(source).distinct(), source, "left_semi").join(keep.select(source, link).distinct(), [source, link], "left_anti")
    return target.join(stale.select(source, link), [source, link], "left_anti")


def upsert_change_tracked(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Overwrite the state; `last_changed_at` moves only when a fingerprint arrives that differs."""
    t = target.select(key, F.struct(*[c for c in target.columns if c != key]).alias("_t"))
    s = source.select(key, F.struct(*[c for c in source.columns if c != key]).alias("_s"))
    joined = t.join(s, key, "full_outer")
    old, new, arrived = F.col("_t"), F.col("_s"), F.col("_s").isNotNull()
    moved = new["fingerprint"].isNotNull() & ~new["fingerprint"].eqNullSafe(old["fingerprint"])
    changed = F.when(arrived & moved, new["last_checked_at"]).otherwise(old["last_changed_at"])
    out = [
        changed.alias(c) if c == "last_changed_at" else F.when(arrived, new[c]).otherwise(old[c]).alias(c)
        for c in target.columns
        if c != key
    ]
    return joined.select(key, *out)


def reimport_latest(attachments: DataFrame, listing: DataFrame, owner: str = "tender_id", name: str = "name", seq: str = "id") -> DataFrame:
    """After a new listing only its names are latest: one stored row per name (downloaded
    first, then newest) is flagged, unknown names are inserted."""
    names = listing.select(owner, name).distinct()
    known = attachments.join(names, [owner, name], "left_semi")
    downloaded = F.col("local_path").isNotNull() & F.col("sha256").isNotNull()
    pick = prefer_then_latest(known, [owner, name], downloaded, seq).select(seq, F.lit(True).alias("_pick"))
    touched = names.select(owner).distinct().withColumn("_touched", F.lit(True))
    flag = F.when(F.col("_touched").isNull(), F.col("is_latest")).otherwise(F.coalesce("_pick", F.lit(False)))
    kept = attachments.join(pick, seq, "left").join(touched, owner, "left").withColumn("is_latest", flag).select(*attachments.columns)
    fresh = names.join(attachments.select(owner, name).distinct(), [owner, name], "left_anti").withColumn("is_latest", F.lit(True))
    return kept.unionByName(fresh, allowMissingColumns=True)


def upsert_tender(target: DataFrame, source: DataFrame, key: str = "eshidis_id") -> DataFrame:
    """Update by registry id, else insert with status UNKNOWN / 0; `created_at` and the status stay."""

    def pick(c, old, new, arrived):
        if c == "created_at":
            return F.coalesce(old, new)
        if c == "status":
            return F.coalesce(old, F.lit("UNKNOWN"))
        if c == "status_confidence":
            return F.coalesce(old, F.lit(0.0))
        return F.when(arrived, new).otherwise(old)

    return _merge(target, source, [key], pick)


def clear_expired_payload(docs: DataFrame, expired: DataFrame, key: str, payload: Sequence[str] = ("local_path", "size_bytes", "sha256")) -> DataFrame:
    """Stored file fields of expired rows to null; `cleared` marks the records that held a file."""
    gone = expired.select(key).distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull() & F.col(payload[0]).isNotNull()
    marked = docs.join(gone, key, "left").withColumn("cleared", hit).withColumn("cleared_bytes", F.when(hit, F.col("size_bytes")))
    for c in payload:
        marked = marked.withColumn(c, F.when(~F.col("cleared"), F.col(c)))
    return marked.drop("_gone")


def clear_summary(cleared: DataFrame) -> DataFrame:
    """Records and bytes cleared."""
    return cleared.agg(F.count_if("cleared").alias("records"), F.coalesce(F.sum("cleared_bytes"), F.lit(0)).alias("bytes"))


def append_run(log: DataFrame, event: DataFrame) -> DataFrame:
    """The run log only grows."""
    return log.unionByName(event, allowMissingColumns=True)


def latest_run_state(log: DataFrame, key: str, at: str, fields: Sequence[str]) -> DataFrame:
    """Current state of each run: first event opens it, last one gives status and summary."""
    last = F.max(F.struct(at, *fields)).alias("_l")
    return log.groupBy(key).agg(F.min(at).alias("started_at"), last).select(
        key, "started_at", F.col(f"_l.{at}").alias("updated_at"), *[F.col(f"_l.{f}").alias(f) for f in fields]
    )


def append_capped(log: DataFrame, new: DataFrame, seq: Sequence[str], n: int) -> DataFrame:
    """Append, keep the last n."""
    return log.unionByName(new).orderBy(*[F.col(c).desc() for c in seq]).limit(n)


def insert_hits(hits: DataFrame, run_id: Column, provenance: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Hits of a search run with their origin as JSON."""
    return hits.select(run_id.alias("run_id"), *keep, F.to_json(F.struct(*provenance)).alias("provenance"))


def patch_json(column: Column, key: str, value: Column) -> Column:
    """Set one top-level key of a JSON object, keep the others; text that is no object counts as empty."""
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    current = F.coalesce(F.from_json(column, "map<string,string>"), empty)
    others = F.map_filter(F.coalesce(current, empty), lambda k, v: k != key)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(key), value.cast("string"))))


def verified_links(rows: DataFrame, source: str, ids: Column, fetch_ok: Column) -> DataFrame:
    """Edges to numeric registry ids whose official page was fetched."""
    return rows.filter(fetch_ok).select(source, F.explode(F.array_distinct(ids)).alias("target_id")).filter(F.col("target_id").rlike(r"^\d+$")).distinct()


def merge_document_index(old: DataFrame, new: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Two indexes by id, entries of the later one win."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    order = F.struct("_src", *([seq] if seq else []))
    return last_wins(both.withColumn("_order", order), key, "_order").drop("_src", "_order")


def delete_keys(target: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove the rows of the given keys (one user's, or everybody's when the user is no key)."""
    return target.join(keys_df.select(*keys).distinct(), list(keys), "left_anti")


def apply_feedback(dismissals: DataFrame, overrides: DataFrame, feedback: DataFrame, key: str = "row_key") -> tuple[DataFrame, DataFrame]:
    """FORCE_KEEP removes the dismissal; every feedback becomes the key's override."""
    forced = feedback.filter(F.col("action") == "FORCE_KEEP")
    return delete_keys(dismissals, forced, [key]), upsert_replace(overrides, feedback, [key])


def merge_act_chain(index: DataFrame, chain: DataFrame, key: str) -> DataFrame:
    """Add a chain's linked ids and attachments to the index entry it belongs to."""
    joined = index.join(chain.select(key, F.col("linked_ids").alias("_ids"), F.col("attachments").alias("_files")), key, "left")
    none = F.array().cast("array<string>")

    def both(a: str, b: str) -> Column:
        return F.array_union(F.coalesce(a, none), F.coalesce(b, none))

    return joined.withColumn("linked_ids", both("linked_ids", "_ids")).withColumn("attachments", both("attachments", "_files")).drop("_ids", "_files")
