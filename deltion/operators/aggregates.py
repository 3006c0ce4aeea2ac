"""Aggregations (E*): conditional counts, scores, completeness, alerts.

All are partial aggregations or joins of grouped counts. Lists that could grow with a group are
returned as rows of a second table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def report_summary(df: DataFrame, errors: Column | None = None) -> DataFrame:
    """Counts of a candidate report in one pass.

    df: source, record_type, status, in_focus (bool), keep (bool).
    """
    focus, keep = F.col("in_focus"), F.col("keep")
    kept = focus & keep
    return df.agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_if(kept).alias("focus_candidates"),
        *[F.count_if(F.col("source") == s).alias(f"{s.lower()}_candidates") for s in ("ESHIDIS", "KIMDIS", "AUTHORITY")],
        F.count_if(kept & (F.col("record_type") == "PROC") & (F.col("status") == "SUBMISSION_OPEN_CANDIDATE")).alias("focus_open_proc"),
        F.count_if(kept & (F.col("source") == "AUTHORITY")).alias("focus_authority"),
        F.count_if(focus & ~keep).alias("focus_filtered_non_public_works"),
        F.count_if(focus & (F.col("record_type") == "PROC") & (F.col("status") == "SUBMISSION_EXPIRED_CANDIDATE")).alias("focus_expired_proc"),
        F.count_if(focus & F.col("record_type").isin("AWRD", "SYMV")).alias("focus_historical"),
        (errors if errors is not None else F.lit(0)).cast("long").alias("errors"),
    )


def decision_histogram(df: DataFrame, decision: str = "decision", keep: str = "keep") -> DataFrame:
    """Rows per decision with kept and dropped."""
    return df.groupBy(F.coalesce(decision, F.lit("REVIEW_TENDER_CANDIDATE")).alias(decision)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(keep)).alias("kept"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("dropped")
    )


def count_by_source(df: DataFrame, source: str = "source_id") -> DataFrame:
    """E3."""
    return df.filter(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def tender_scores(hits: DataFrame, key: str) -> DataFrame:
    """Total score (two decimals) and hit count per tender, with its rules by falling score.

    Hits are first counted per (tender, rule), so the list is as long as the rule list.
    """
    per_rule = hits.groupBy(key, "rule_id", "score").agg(F.count(F.lit(1)).alias("n"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "rule_id", "n")))
    total = F.round(F.sum(F.col("score").cast("decimal(18,4)") * F.col("n")), 2)
    scored = per_rule.groupBy(key).agg(total.alias("total_score"), F.sum("n").alias("hit_count"), best.alias("_r"))
    rules = F.transform("_r", lambda x: F.concat_ws("x", x["rule_id"], x["n"].cast("string")))
    return scored.withColumn("rules", F.array_join(rules, ",")).drop("_r").orderBy(F.col("total_score").desc(), F.col(key))


def document_counts(attachments: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """E5: latest attachments and analysed documents per tender."""
    analysed = docs.groupBy("attachment_id").agg(F.count(F.lit(1)).alias("_docs"))
    return attachments.filter("is_latest").join(analysed, "attachment_id", "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("latest_attachments"), F.coalesce(F.sum("_docs"), F.lit(0)).alias("documents")
    )


def storage_flags(df: DataFrame, desired: Column) -> DataFrame:
    """Storage status of each pricing document.

    df: local_path, local_exists, text_exists.
    """
    path_set, there = F.col("local_path").isNotNull(), F.coalesce("local_exists", F.lit(False))
    stale = path_set & ~there
    return df.select(
        "*", desired.alias("desired_preserved"), path_set.alias("local_path_set"), stale.alias("stale_local_path"),
        (desired & ~there).alias("needs_refetch"), (stale & ~desired).alias("stale_non_preserved"),
    )


STORAGE_FLAGS = [
    "desired_preserved", "local_path_set", "local_exists", "stale_local_path", "text_exists", "needs_refetch", "stale_non_preserved",
]


def storage_audit(flags: DataFrame, project: str) -> DataFrame:
    """Counts per project and in total (project null) in one pass."""
    counts = [F.count_if(F.col(f)).alias(f) for f in STORAGE_FLAGS]
    return flags.rollup(project).agg(F.count(F.lit(1)).alias("documents"), *counts)


def repair_plan(flags: DataFrame, listing: DataFrame, project: str, name: str) -> DataFrame:
    """What to do per project and attachment: refetch (in the listing), missing from the
    listing, or mark a stale path deleted."""
    root = F.split_part(F.translate(F.col(name), "\\", "/"), F.lit("/"), F.lit(1))
    wanted = flags.filter("needs_refetch").select(project, root.alias("root_name")).distinct()
    listed = listing.select(project, "root_name", F.lit(True).alias("_listed")).distinct()
    action = F.when(F.col("_listed").isNotNull(), "REFETCH").otherwise("MISSING_FROM_LISTING")
    fetch = wanted.join(listed, [project, "root_name"], "left").select(project, "root_name", action.alias("action"))
    stale = flags.filter("stale_non_preserved").select(project, F.col(name).alias("root_name"), F.lit("MARK_DELETED").alias("action"))
    return fetch.unionByName(stale)


def project_completeness(documents: DataFrame, merged: DataFrame, audit: DataFrame, key: str) -> DataFrame:
    """complete = documents, texts and merged rows exist and both validations passed.

    documents: key, has_text; merged: key; audit: key, amounts_ok, totals_ok.
    """
    docs = documents.groupBy(key).agg(F.count(F.lit(1)).alias("documents"), F.count_if("has_text").alias("texts"))
    rows = merged.groupBy(key).agg(F.count(F.lit(1)).alias("merged_rows"))
    joined = docs.join(rows, key, "full_outer").join(audit, key, "left").na.fill(0, ["documents", "texts", "merged_rows"])
    ok = F.coalesce("amounts_ok", F.lit(False)) & F.coalesce("totals_ok", F.lit(False))
    return joined.withColumn("complete", (F.col("documents") > 0) & (F.col("texts") > 0) & (F.col("merged_rows") > 0) & ok)


def live_counts(projects: DataFrame, documents: DataFrame, rows: DataFrame, since: Column) -> DataFrame:
    """What arrived since a run started, in one row."""
    p = projects.agg(F.count_if(F.col("first_seen_at") >= since).alias("projects"))
    fresh = F.col("fetched_at") >= since
    d = documents.agg(F.count_if(fresh).alias("documents"), F.count_if(fresh & F.col("has_text")).alias("text_docs"))
    r = rows.agg(F.count_if(F.col("extracted_at") >= since).alias("merged_rows"))
    stacked = p.unionByName(d, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def newest_projects(projects: DataFrame, since: Column, key: str, k: int) -> DataFrame:
    """The newest projects since a run started."""
    return projects.filter(F.col("first_seen_at") >= since).orderBy(F.col("first_seen_at").desc(), F.col(key)).limit(k)


def polling_rows(configured: DataFrame, state: DataFrame, health: DataFrame) -> DataFrame:
    """Configured and known sources with state and health.

    configured: source_id, selective; state: source_id, last_status, last_error, last_checked_at; health: source_id, status.
    """
    c = configured.withColumn("configured", F.lit(True))
    joined = c.join(state.withColumn("tracked", F.lit(True)), "source_id", "full_outer").join(health.select("source_id", F.col("status").alias("health_status")), "source_id", "left")
    return joined.withColumn("last_status", F.coalesce("last_status", F.lit("NEVER_CHECKED"))).na.fill(False, ["configured", "tracked", "selective"])


def polling_summary(rows: DataFrame) -> DataFrame:
    """Thirteen counts and the last check over all sources."""
    status, selective = F.col("last_status"), F.col("selective")
    error = (status == "ERROR") | (F.coalesce("last_error", F.lit("")) != "")
    return rows.agg(
        F.count_if("configured").alias("configured_total"),
        F.count_if("tracked").alias("tracked_total"),
        F.count_if(status == "CHANGED").alias("changed_total"),
        F.count_if((status == "CHANGED") & selective).alias("selective_changed_total"),
        F.count_if(status == "SKIPPED_UNCHANGED").alias("unchanged_total"),
        F.count_if(error).alias("error_total"),
        F.count_if(error & selective).alias("selective_error_total"),
        F.count_if(status == "REQUIRES_IDENTIFIER").alias("requires_identifier_total"),
        F.count_if(status == "NEVER_CHECKED").alias("never_checked_total"),
        F.count_if(selective).alias("selective_capable_total"),
        F.count_if(F.col("health_status").isin("WATCH", "DEGRADED", "DISABLE_CANDIDATE")).alias("health_warning_total"),
        F.count_if(F.col("health_status") == "DISABLE_CANDIDATE").alias("disable_candidate_total"),
        F.max("last_checked_at").alias("last_checked_at"),
    )


REACHABLE = ["REACHABLE", "ADAPTER_READY"]
FAILED = ["FAILED", "HTTP_ERROR"]


def mark_fallbacks(sources: DataFrame, scope: str) -> DataFrame:
    """A failed source has a fallback when another of its scope is reachable.

    sources: scope, status, adapter_required. The scope's flag is aggregated map-side and joined.
    """
    scopes = sources.groupBy(scope).agg(F.bool_or(F.col("status").isin(REACHABLE)).alias("_reach"))
    failed = F.col("status").isin(FAILED)
    return (
        sources.join(scopes, scope, "left").withColumn("fallback_available", failed & F.coalesce("_reach", F.lit(False)))
        .withColumn("adapter_required", F.col("adapter_required") & ~F.col("fallback_available")).drop("_reach")
    )


def audit_summary(marked: DataFrame) -> DataFrame:
    """E14."""
    failed = F.col("status").isin(FAILED)
    return marked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(REACHABLE)).alias("reachable"), F.count_if(failed).alias("failed"),
        F.count_if("adapter_required").alias("adapter_required"), F.count_if(F.col("status") == "TEMPLATE_REQUIRES_IDENTIFIER").alias("templates"),
        F.count_if(failed & F.col("fallback_available")).alias("failed_with_fallback"),
        F.count_if(F.col("adapter_required") & ~F.col("fallback_available")).alias("unresolved_blockers"),
    )


def batch_accounting(items: DataFrame) -> DataFrame:
    """Outcome counts of a batch of projects and the status of the run.

    items: valid, existing_complete, ok, complete.
    """
    outcome = (
        F.when(~F.col("valid"), "skipped_invalid").when(F.col("existing_complete"), "skipped_existing").when(~F.col("ok"), "failed")
        .when(F.col("complete"), "completed").otherwise("partial")
    )
    names = ["completed", "partial", "failed", "skipped_existing", "skipped_invalid"]
    counted = items.select(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])
    clean_run = (F.col("failed") == 0) & (F.col("partial") == 0) & (F.col("skipped_invalid") == 0)
    return counted.withColumn("status", F.when(clean_run, "COMPLETED").otherwise("INCOMPLETE"))


def monitoring_alerts(metrics: DataFrame) -> DataFrame:
    """Alerts of a one-row metrics table (columns missing from it count as 0 or true)."""
    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in metrics.columns else F.lit(0)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(True)) if name in metrics.columns else F.lit(True)

    def alert(test: Column, severity: str, code: str, message: Column) -> Column:
        return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")))

    skipped = F.coalesce(F.col("discovery_skipped"), F.lit(False)) if "discovery_skipped" in metrics.columns else F.lit(False)
    rules = [
        alert(number("stage_errors") > 0, "ERROR", "STAGE_FAILED", F.lit("Scheduled stage failed.")),
        alert((number("sources_configured") > 0) & (number("sources_checked") == 0), "ERROR", "NO_SOURCES_CHECKED",
              F.lit("No configured public-works source has a completed recent polling state.")),
        alert(number("source_errors") > 0, "WARNING", "SOURCE_ERRORS",
              F.concat(number("source_errors").cast("string"), F.lit(" source(s) reported errors in the latest polling state."))),
        alert(number("source_health_warnings") > 0, "WARNING", "SOURCE_HEALTH_WARNINGS",
              F.concat(number("source_health_warnings").cast("string"), F.lit(" source(s) are degraded or need attention."))),
        alert(~flag("payment_scan_ok"), "WARNING", "ENTALMATA_SCAN_FAILED", F.lit("Payment-order scan failed.")),
        alert(~flag("document_fetch_ok"), "WARNING", "AUTO_DOCUMENT_FETCH_FAILED", F.lit("Automatic document fetch did not complete cleanly.")),
        alert((number("new_rows") > 0) & ~(F.col("dry_run") if "dry_run" in metrics.columns else F.lit(False)) & (number("sent") == 0),
              "ERROR", "EMAIL_NOT_SENT", F.lit("New public-works rows existed but no email was sent.")),
        alert((number("sources_changed") > 0) & (number("candidate_rows") == 0) & ~skipped, "WARNING", "ZERO_PUBLIC_WORKS_CANDIDATES",
              F.lit("Changed sources produced zero public-works dashboard candidates.")),
    ]
    return metrics.select(F.inline(F.array_compact(F.array(*rules))))


def monitoring_status(alerts: DataFrame) -> DataFrame:
    """Worst severity."""
    return alerts.agg(
        F.when(F.coalesce(F.bool_or(F.col("severity") == "ERROR"), F.lit(False)), "ERROR").when(F.count(F.lit(1)) > 0, "WARNING").otherwise("OK").alias("status"),
        F.count(F.lit(1)).alias("alerts"),
    )


def grid_metrics(bodies: DataFrame, body: str) -> DataFrame:
    """Highest declared row count and rows found in grid responses."""
    text = F.col(body)
    declared = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r'_rowCount="(\d+)"'), F.lit(1)), lambda x: x.try_cast("int")))
    rows = F.size(F.regexp_extract_all(text, F.lit(r'(?i)<tr\b[^>]*role="row"[^>]*>'), F.lit(0)))
    return bodies.agg(F.max(declared).alias("declared_row_count"), F.sum(rows).alias("rows_parsed"))


def scan_summary(decisions: DataFrame) -> DataFrame:
    """Fate of the decisions of a payment-order scan.

    decisions: in_window, has_document, matched, archived.
    """
    seen = F.col("in_window") & F.col("has_document")
    return decisions.agg(
        F.count(F.lit(1)).alias("decisions_seen"), F.count_if(~F.col("in_window")).alias("outside_window"),
        F.count_if(F.col("in_window") & ~F.col("has_document")).alias("without_document"),
        F.count_if(seen & F.col("matched")).alias("matched"), F.count_if(seen & ~F.col("matched")).alias("rejected"),
        F.count_if("archived").alias("archived"),
    )


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows each stage takes out; the first stage that applies counts."""
    chain = F
    for name, test in stages:
        chain = chain.when(F.coalesce(test, F.lit(False)), name)
    return df.groupBy(chain.otherwise("visible").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def distinct_ids(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per group, sorted, one per line."""
    return df.select(key, value).distinct().orderBy(key, value)


def source_families(candidates: DataFrame, errors: DataFrame, pages: DataFrame, limited: str | None = None) -> DataFrame:
    """Per family the number of distinct ids, errors, pages, and whether the source is exhausted
    (an empty page, or for the `limited` family fewer candidates than its pages asked for).

    candidates: family, candidate_id; errors: family; pages: family, items_returned, items_asked.
    """
    ids = candidates.filter(F.length(F.trim("candidate_id")) > 0).groupBy("family").agg(F.countDistinct("candidate_id").alias("ids"), F.count(F.lit(1)).alias("items"))
    err = errors.groupBy("family").agg(F.count(F.lit(1)).alias("errors"))
    pag = pages.groupBy("family").agg(F.count(F.lit(1)).alias("pages"), F.bool_or(F.col("items_returned") == 0).alias("_empty"), F.sum("items_asked").alias("_asked"))
    joined = reduce(lambda a, b: a.join(b, "family", "full_outer"), [ids, err, pag]).na.fill(0, ["ids", "items", "errors", "pages"])
    exhausted = F.coalesce("_empty", F.lit(False))
    if limited is not None:
        exhausted = F.when(F.col("family") == limited, F.col("items") < F.col("_asked")).otherwise(exhausted)
    return joined.withColumn("exhausted", exhausted).drop("_empty", "_asked", "items")


def stage_summary(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixed keys of each stage's JSON result, and whether it succeeded."""
    return results.select("stage", *[F.get_json_object("result", f"$.{k}").alias(k) for k in keys])


def enrichment_summary(attempts: DataFrame, targets: Column) -> DataFrame:
    """Outcome of a look-up run.

    attempts: ok, linked_count, verified_count.
    """
    return attempts.agg(
        targets.cast("long").alias("targets"), F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("linked_count") > 0).alias("enriched"),
        F.coalesce(F.sum("verified_count"), F.lit(0)).alias("verified_links"), F.count_if(~F.col("ok")).alias("failed"),
        F.greatest(targets.cast("long") - F.count(F.lit(1)), F.lit(0)).alias("remaining"),
    )
