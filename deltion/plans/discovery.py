"""K1 unified candidates, K5 profile search, K6 profile evaluation, K11 payment orders, K12 run report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion.functions.text import fold_terms, haystack, matched_terms, norm_text
from deltion.operators import aggregates, filters, links, monitor
from deltion.operators.ranking import first_wins, list_recent, problem_sources, union_sources
from deltion.operators.state import insert_hits
from deltion.rules import EvaluationRule, Scope, SearchProfile
from deltion.session import settle


def expanded_candidates(producers: Sequence[DataFrame], scopes: Sequence[Scope], gate: dict | None = None, seq: str = "seq", previous: DataFrame | None = None, skipped: DataFrame | None = None, source_key: str = "source") -> DataFrame:
    """K1: candidates of all producers: first of each official key, with scopes and works decision.

    producers: source, record_type, official_id, title, authority, attachment_url, status, seq. Rows of `skipped` sources
    (by `source_key`) come from the `previous` report, which has match_notes besides, and carry a note; what a producer
    still gives of such a source comes first.
    """
    rows = union_sources(*producers)
    if previous is not None and skipped is not None:
        if "match_notes" not in rows.columns:
            rows = rows.withColumn("match_notes", F.array().cast("array<string>"))
        last = rows.agg(F.coalesce(F.max(seq), F.lit(0)).alias("n")).first().n
        rows = links.carry_forward(rows, previous.withColumn(seq, F.col(seq) + last + 1), skipped, source_key)
    rows = first_wins(rows, ["source", "record_type", "official_id"], seq)
    details = F.concat_ws(" ", "source", "record_type", "official_id", "title", "authority", "attachment_url")
    scoped = rows.withColumn("scope_matches", filters.scope_match(details, scopes)).withColumn("_f", haystack(details))
    decided = filters.works_gate(F.col("_f"), F.col("source"), F.col("record_type"), F.coalesce("attachment_url", F.lit("")) != "", **(gate or {}))
    return (
        scoped.withColumn("gate", decided).drop("_f").withColumn("keep", F.col("gate.keep")).withColumn("in_focus", F.size("scope_matches") > 0)
    )


def expanded_summary(rows: DataFrame, errors: Column | None = None) -> DataFrame:
    """K1: the counts of the report."""
    return aggregates.report_summary(rows, errors)


def search_profile(docs: DataFrame, attachments: DataFrame, tenders: DataFrame, profile: SearchProfile, run_id: str) -> DataFrame:
    """K5: evidence for a profile in the searchable documents, as hits of a run."""
    searchable = links.searchable_documents(docs, attachments, tenders, profile.document_types)
    keep = ["tender_id", "eshidis_id", "doc_id", "name", "document_type"]
    hits = links.match_terms(searchable, profile, "text", "document_type", keep).withColumn("profile_id", F.lit(profile.profile_id))
    origin = ["profile_id", "term", "match_type", "pos", "document_type", F.col("name").alias("original_name")]
    return insert_hits(hits, F.lit(run_id), origin, [*keep, "match_type", "term", "confidence", "context"])


def evaluate_profile(docs: DataFrame, attachments: DataFrame, tenders: DataFrame, rules: Sequence[EvaluationRule]) -> DataFrame:
    """K6: score per tender over the rule hits of its documents."""
    searchable = links.searchable_documents(docs, attachments, tenders)
    hits = links.evaluate_rules(searchable, rules, "text", "document_type", ["tender_id", "eshidis_id", "doc_id"])
    return aggregates.tender_scores(hits, "eshidis_id")


def payment_orders(decisions: DataFrame, keywords: Sequence[str], today: Column, days: int = 15) -> DataFrame:
    """Decisions of a scan with their fate: outside the window, without document, matched or not,
    archived once they leave the window.

    decisions: org, page, ada, issue_date (date), document_url, text, previous_status.
    """
    from deltion.operators.ranking import prefix_until_exhausted

    inside = F.coalesce(F.col("issue_date") >= F.date_sub(today, days - 1), F.lit(False))
    read = prefix_until_exhausted(decisions, "org", "page", ~inside)
    has_document = F.coalesce("document_url", F.lit("")) != ""
    folded = read.withColumn("_f", norm_text(F.col("text")))
    found = matched_terms(F.col("_f"), fold_terms(keywords), list(keywords))
    out = folded.withColumn("matched_keywords", found).drop("_f").withColumn("in_window", inside).withColumn("has_document", has_document)
    status = F.when(F.col("in_window") & has_document, F.when(F.size("matched_keywords") > 0, "VISIBLE").otherwise("REJECTED")).otherwise(F.col("previous_status"))
    return monitor.archive_visible(out.withColumn("status", status), "issue_date", today, days).withColumnRenamed("archived_now", "archived").withColumn("matched", F.size("matched_keywords") > 0)


def payment_order_report(decisions: DataFrame, keywords: Sequence[str], today: Column, days: int = 15) -> dict[str, DataFrame]:
    """A scan of decisions with its counts (E18) and the visible orders of the window, newest first.

    decisions: as for `payment_orders`, and fetched_at.
    """
    orders = settle(payment_orders(decisions, keywords, today, days))
    return {"decisions": orders, "summary": aggregates.scan_summary(orders), "recent": list_recent(orders, "issue_date", "fetched_at", "ada", F.date_sub(today, days - 1))}


def run_report(polling: DataFrame, run: DataFrame) -> dict[str, DataFrame]:
    """Metrics of a scheduled run, its alerts, status and problem sources.

    `run` is one row: new_rows, candidate_rows, sent, ...
    """
    one = F.lit(1).alias("_one")
    summary = aggregates.polling_summary(polling).select(
        F.col("configured_total").alias("sources_configured"), (F.col("tracked_total")).alias("sources_checked"), F.col("changed_total").alias("sources_changed"),
        F.col("error_total").alias("source_errors"), F.col("health_warning_total").alias("source_health_warnings"), one,
    )
    metrics = summary.join(run.select("*", one), "_one").drop("_one")
    alerts = aggregates.monitoring_alerts(metrics)
    return {"metrics": metrics, "alerts": alerts, "status": aggregates.monitoring_status(alerts), "problems": problem_sources(polling, 12)}


