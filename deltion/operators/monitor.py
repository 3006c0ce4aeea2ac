"""Source health and incremental decisions (F4, J1-J4, J8-J10, A13) as batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion.operators.ranking import top_per_key
from deltion.operators.state import upsert_change_tracked, upsert_replace


def run_failed(status: Column, error: Column) -> Column:
    return (F.coalesce(status, F.lit("")) == "ERROR") | (F.coalesce(error, F.lit("")) != "")


def source_health(runs: DataFrame, source: str, at: str, seq: str, failed: Column, n: int) -> DataFrame:
    """health of each source over its last n runs."""
    last = top_per_key(runs.withColumn("_failed", failed), source, [F.col(at).desc(), F.col(seq).desc()], n, rank="_rn")
    stats = last.groupBy(source).agg(
        F.count(F.lit(1)).alias("recent_checks"), F.count_if("_failed").alias("recent_failures"),
        F.coalesce(F.min(F.when(~F.col("_failed"), F.col("_rn"))) - 1, F.count(F.lit(1))).alias("consecutive_failures"),
        F.max(F.when(~F.col("_failed"), F.col(at))).alias("last_success_at"),
    )
    c, f, k = F.col("recent_checks"), F.col("recent_failures"), F.col("consecutive_failures")
    status = (
        F.when((k >= 5) | ((c >= 10) & (f >= c * 0.8)), "DISABLE_CANDIDATE").when((k >= 2) | ((c >= 5) & (f >= c * 0.4)), "DEGRADED")
        .when(f > 0, "WATCH").otherwise("HEALTHY")
    )
    return stats.withColumn("status", status)


def health_from_status(status: Column, error: Column) -> Column:
    """health of a source without a run log."""
    return F.when(status == "NEVER_CHECKED", "UNKNOWN").when(run_failed(status, error), "WATCH").otherwise("HEALTHY")


def source_fingerprint(items: DataFrame, source: str, position: str, token: str, date: str) -> DataFrame:
    """Newest item's token and date per source, number of items, and a signature."""
    newest = F.min_by(F.struct(F.col(token).alias("token"), F.col(date).alias("date")), F.col(position)).alias("_n")
    out = items.groupBy(source).agg(newest, F.count(F.lit(1)).alias("count_hint")).select(source, "_n.token", "_n.date", "count_hint")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (source, "token", "date", "count_hint")]
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("|", *parts), 256))


def global_fingerprint(fingerprints: DataFrame, status: str | None = None) -> DataFrame:
    """One hash over all sources, in any order, and counts by kind.

    The hash adds up the per-source hashes, in four pieces of 16 digits, so it needs no ordered list.
    """
    pieces = [F.sum(F.conv(F.substring("fingerprint", at, 16), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 17, 33, 49)]
    kinds = []
    if status:
        kinds = [
            F.count_if(F.col(status) != "REQUIRES_IDENTIFIER").alias("attempted_total"), F.count_if(F.col(status) == "REACHED").alias("reached_total"),
            F.count_if(F.col(status) == "REQUIRES_IDENTIFIER").alias("template_total"), F.count_if(F.col(status) == "ERROR").alias("error_total"),
        ]
    return fingerprints.agg(F.concat_ws("-", *pieces).alias("hash"), F.count(F.lit(1)).alias("configured_total"), *kinds)


def overlap_watermark(previous: DataFrame, current: DataFrame, exhausted: DataFrame) -> DataFrame:
    """Per family whether a run reached the previous window.

    previous, current: family, candidate_id; exhausted: family, exhausted. A family is complete when
    ids overlap, there were no previous ids, or the source has no more pages.
    """
    p = previous.distinct().withColumn("_p", F.lit(1))
    c = current.distinct().withColumn("_c", F.lit(1))
    counts = p.join(c, ["family", "candidate_id"], "full_outer").groupBy("family").agg(
        F.count("_p").alias("previous_count"), F.count("_c").alias("current_count"), F.count(F.col("_p") + F.col("_c")).alias("overlap")
    )
    joined = counts.join(exhausted, "family", "full_outer").na.fill(0, ["previous_count", "current_count", "overlap"]).na.fill(False, ["exhausted"])
    reached = (F.col("overlap") > 0) | (F.col("previous_count") == 0)
    return joined.withColumn("reached_previous", reached).withColumn("complete", reached | F.col("exhausted"))


def watermark_status(families: DataFrame) -> DataFrame:
    """Complete only when every family is."""
    done = F.coalesce(F.bool_and("complete"), F.lit(True))
    return families.agg(done.alias("complete"), F.when(done, "PREVIOUS_WINDOW_REACHED_OR_SOURCE_EXHAUSTED").otherwise("NEEDS_DEEPER_BACKFILL").alias("stop_reason"))


def run_record(families: DataFrame, watermark: DataFrame) -> DataFrame:
    """A run succeeded when no family had errors and the watermark is complete."""
    w = watermark.select("complete", "stop_reason", F.lit(1).alias("_one"))
    f = families.agg(F.sum("errors").alias("errors"), F.sum("ids").alias("candidate_ids"), F.lit(1).alias("_one"))
    return f.join(w, "_one").drop("_one").withColumn("source_success", F.col("errors") == 0).withColumn("success", (F.col("errors") == 0) & F.col("complete"))


def changed_sources(previous: DataFrame, current: DataFrame, key: str = "source_id", relevant: DataFrame | None = None) -> DataFrame:
    """Current sources whose fingerprint is new or different."""
    joined = current.select(key, "fingerprint").join(previous.select(key, F.col("fingerprint").alias("_before")), key, "left")
    changed = joined.filter(~F.col("fingerprint").eqNullSafe(F.col("_before"))).select(key)
    return changed.join(relevant.select(key), key, "left_semi") if relevant is not None else changed


def change_preflight(previous: DataFrame, current: DataFrame, errors: DataFrame, key: str = "source_id") -> DataFrame:
    """Whether the expensive run can be skipped, in one row.

    Exact: no errors and nothing changed. Partial: errors, but at least 75 % of the previous sources
    were reached and none of them changed. Degraded: errors and nothing changed.
    """
    p, c = previous.select(key, F.col("fingerprint").alias("_p")), current.select(key, F.col("fingerprint").alias("_c"))
    both = p.join(c, key, "full_outer")
    has_p, has_c = F.col("_p").isNotNull(), F.col("_c").isNotNull()
    same = F.col("_p").eqNullSafe(F.col("_c"))
    facts = both.agg(
        F.count_if(has_p).alias("previous_sources"), F.count_if(has_c).alias("current_sources"), F.count_if(has_p & has_c).alias("overlap"),
        F.count_if(has_c & ~same).alias("changed"), F.count_if(has_p & has_c & ~same).alias("changed_known"), F.lit(1).alias("_one"),
    ).join(errors.agg(F.count(F.lit(1)).alias("errors"), F.lit(1).alias("_one")), "_one").drop("_one")
    base = F.col("previous_sources") > 0
    enough = F.col("overlap") >= F.greatest(F.lit(1), F.floor(F.col("previous_sources") * 0.75))
    exact = base & (F.col("errors") == 0) & (F.col("changed") == 0)
    partial = base & (F.col("errors") > 0) & enough & (F.col("changed_known") == 0)
    degraded = base & (F.col("errors") > 0) & (F.col("changed") == 0)
    status = (
        F.when(exact, "SKIPPED_UNCHANGED").when(partial, "SKIPPED_UNCHANGED_WITH_SOURCE_WARNINGS")
        .when(degraded, "SKIPPED_DEGRADED_NO_SUCCESSFUL_SOURCE_CHANGES").otherwise("CHANGED_OR_NO_BASELINE")
    )
    return facts.withColumn("status", status).withColumn("skip", exact | partial | degraded)


def preflight_state(current: DataFrame, state: DataFrame, key: str = "source_id") -> DataFrame:
    """The state row each checked source gets; an error keeps the last good fingerprint.

    current: source_id, fingerprint, reachable, requires_identifier, error, last_checked_at;
    state: source_id, fingerprint, last_changed_at, last_checked_at, last_status, last_error.
    """
    before = state.select(key, F.col("fingerprint").alias("_before"))
    joined = current.join(before, key, "left")
    status = (
        F.when(F.col("requires_identifier"), "REQUIRES_IDENTIFIER").when(~F.coalesce("reachable", F.lit(False)), "ERROR")
        .when(F.col("fingerprint").eqNullSafe(F.col("_before")), "SKIPPED_UNCHANGED").otherwise("CHANGED")
    )
    kept = F.when(F.coalesce("reachable", F.lit(False)) | F.col("requires_identifier"), F.col("fingerprint")).otherwise(F.col("_before"))
    return joined.select(key, kept.alias("fingerprint"), "last_checked_at", status.alias("last_status"), F.col("error").alias("last_error"))


def persist_preflight(current: DataFrame, state: DataFrame, key: str = "source_id") -> DataFrame:
    """New state table after a preflight."""
    return upsert_change_tracked(state, preflight_state(current, state, key), key)


def split_pending(rows: DataFrame, previous: DataFrame, key: str, signature: str) -> DataFrame:
    """Rows with `pending` true where the stored signature is missing or different."""
    stored = previous.select(key, F.col(signature).alias("_stored"))
    return rows.join(stored, key, "left").withColumn("pending", ~F.coalesce(F.col(signature) == F.col("_stored"), F.lit(False))).drop("_stored")


def merge_labels(split: DataFrame, previous: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Retained rows keep their label, pending ones take the new one, or review with confidence 0."""
    old = previous.select(key, F.struct("decision", "confidence").alias("_old"))
    new = fresh.select(key, F.struct("decision", "confidence").alias("_new"))
    joined = split.join(old, key, "left").join(new, key, "left")
    chosen = F.when(F.col("pending"), F.col("_new")).otherwise(F.col("_old"))
    return (
        joined.withColumn("decision", F.coalesce(chosen["decision"], F.lit("REVIEW_TENDER_CANDIDATE")))
        .withColumn("confidence", F.coalesce(chosen["confidence"], F.lit(0.0))).drop("_old", "_new")
    )


def attempt_ledger(ledger: DataFrame, attempts: DataFrame, key: str = "row_key") -> DataFrame:
    """The last attempt per row, with the signature it was made for."""
    return upsert_replace(ledger, attempts, [key])


def refresh_plan(changed: DataFrame, selectable: DataFrame, has_baseline: bool, key: str = "source_id") -> DataFrame:
    """Whether only changed sources are refreshed: a baseline exists, something changed, and every
    changed source can be refreshed alone."""
    known = changed.join(selectable.select(key, F.lit(True).alias("_ok")), key, "left")
    facts = known.agg(F.count(F.lit(1)).alias("changed"), F.coalesce(F.bool_and(F.coalesce("_ok", F.lit(False))), F.lit(False)).alias("all_selectable"))
    return facts.withColumn("selective", F.lit(has_baseline) & (F.col("changed") > 0) & F.col("all_selectable"))


def refresh_sources(configured: DataFrame, changed: DataFrame, selectable: DataFrame, has_baseline: bool, key: str = "source_id") -> DataFrame:
    """The sources to refresh."""
    selective = refresh_plan(changed, selectable, has_baseline, key).select("selective").scalar()
    marked = configured.join(changed.select(key, F.lit(True).alias("_changed")), key, "left")
    return marked.filter(~selective | F.col("_changed")).drop("_changed")


def reuse_document(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A stored document is reused when its signature matches, it has a file and no error."""
    s = stored.select(*keys, F.struct("source_signature", "fetch_error", "local_path", "sha256").alias("_s"))
    ok = (
        (F.col("_s.source_signature") == F.col("source_signature")) & (F.coalesce("_s.fetch_error", F.lit("")) == "")
        & F.col("_s.local_path").isNotNull() & F.col("_s.sha256").isNotNull()
    )
    return wanted.join(s, list(keys), "left").withColumn("reuse", F.coalesce(ok, F.lit(False))).drop("_s")


def archive_visible(df: DataFrame, day: str, today: Column, days: int = 15) -> DataFrame:
    """VISIBLE while the date is at or after today - (days - 1); then ARCHIVED."""
    gone = (F.col("status") == "VISIBLE") & (F.col(day) < F.date_sub(today, days - 1))
    return df.withColumns({"status": F.when(gone, "ARCHIVED").otherwise(F.col("status")), "archived_now": F.coalesce(gone, F.lit(False))})


def reusable_decisions(decisions: DataFrame, stored: DataFrame, key: str = "ada") -> DataFrame:
    """Decisions already processed: same url, final status and text or keywords kept."""
    s = stored.filter(F.col("status").isin("VISIBLE", "REJECTED") & (F.coalesce("text_sample", F.lit("")) != "")).select(key, F.col("document_url").alias("_url"))
    return decisions.join(s, key, "left").withColumn("reuse", F.coalesce(F.col("document_url") == F.col("_url"), F.lit(False))).drop("_url")
