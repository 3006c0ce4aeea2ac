"""Queries for aggregations (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltion.catalog.base import Tables, cte, query
from deltion.catalog.linking import RULES, hits_sql
from deltion.operators import aggregates as agg
from deltion.operators import filters, links, monitor

L, D = "long", "double"

_REPORT = """SELECT source, record_type, CASE WHEN record_type <> 'PROC' THEN 'HISTORICAL' WHEN deadline_iso > '1998-07-17' THEN 'SUBMISSION_OPEN_CANDIDATE' ELSE 'SUBMISSION_EXPIRED_CANDIDATE' END AS status, place IN ('ASIA', 'EUROPE') AS in_focus, segment <> 'BUILDING' AS keep FROM {tenders}"""


@query("e1_report_summary", cte("tenders") + f", r AS ({_REPORT.format(tenders='tenders')})" + """ SELECT count(*) AS total_candidates, count(*) FILTER (in_focus AND keep) AS focus_candidates, count(*) FILTER (source = 'ESHIDIS') AS eshidis_candidates, count(*) FILTER (source = 'KIMDIS') AS kimdis_candidates,
  count(*) FILTER (source = 'AUTHORITY') AS authority_candidates, count(*) FILTER (in_focus AND keep AND record_type = 'PROC' AND status = 'SUBMISSION_OPEN_CANDIDATE') AS focus_open_proc, count(*) FILTER (in_focus AND keep AND source = 'AUTHORITY') AS focus_authority,
  count(*) FILTER (in_focus AND NOT keep) AS focus_filtered_non_public_works, count(*) FILTER (in_focus AND record_type = 'PROC' AND status = 'SUBMISSION_EXPIRED_CANDIDATE') AS focus_expired_proc, count(*) FILTER (in_focus AND record_type IN ('AWRD', 'SYMV')) AS focus_historical, 0::BIGINT AS errors FROM r""")
def _(t: Tables):
    return agg.report_summary(t.sql(_REPORT))


@query("e2_decision_histogram", cte("triage") + " SELECT decision, count(*) AS n, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped FROM triage GROUP BY decision")
def _(t: Tables):
    return agg.decision_histogram(t.triage)


@query("e3_count_by_source", cte("runs") + " SELECT source_id, count(*) AS n FROM runs GROUP BY source_id")
def _(t: Tables):
    return agg.count_by_source(t.runs)


@query("e4_tender_scores", hits_sql() + """, r AS (SELECT source, rule_id, score, count(*) AS n FROM h GROUP BY ALL)
  SELECT source, CAST(round(sum(CAST(score AS DECIMAL(18,4)) * n), 2) AS DOUBLE) AS total_score, CAST(sum(n) AS BIGINT) AS hit_count, string_agg(rule_id || 'x' || n, ',' ORDER BY score DESC, rule_id) AS rules FROM r GROUP BY source""")
def _(t: Tables):
    hits = links.evaluate_rules(t.documents, RULES, "text", "lang", ["doc_id", "source"])
    scores = agg.tender_scores(hits, "source")
    return scores.select("source", F.col("total_score").cast(D).alias("total_score"), "hit_count", "rules")


_ATT = "SELECT l_orderkey AS tender_id, l_orderkey * 10 + l_linenumber AS attachment_id, l_returnflag <> 'R' AS is_latest FROM {lineitem}"


@query("e5_document_counts", f"WITH a AS ({_ATT.format(lineitem='lineitem')})" + ", d AS (SELECT doc_id + 10 AS attachment_id, count(*) AS n FROM documents GROUP BY 1) SELECT tender_id, count(*) AS latest_attachments, CAST(coalesce(sum(n), 0) AS BIGINT) AS documents FROM a LEFT JOIN d ON d.attachment_id = a.attachment_id WHERE is_latest GROUP BY tender_id")
def _(t: Tables):
    return agg.document_counts(t.sql(_ATT), t.documents.select((F.col("doc_id") + 10).alias("attachment_id")), "tender_id")


_STORE = "SELECT document_no AS project, source_document AS document_name, CASE WHEN flag <> 'N' THEN 'p' END AS local_path, flag = 'A' AS local_exists, unit IS NOT NULL AS text_exists, row_number FROM {lines}"
_STORE_SQL = cte("lines") + f", s AS (SELECT *, project % 5 IN (0, 2) AS desired FROM ({_STORE.format(lines='lines')}))"


def _flags(t: Tables):
    docs = t.sql(_STORE)
    return agg.storage_flags(docs, filters.preserve_document(F.col("document_name"), F.lit("")))


@query("e6_storage_audit", _STORE_SQL + """ SELECT project, count(*) AS documents, count(*) FILTER (desired) AS desired_preserved, count(*) FILTER (local_path IS NOT NULL) AS local_path_set, count(*) FILTER (local_exists) AS local_exists, count(*) FILTER (local_path IS NOT NULL AND NOT local_exists) AS stale_local_path,
  count(*) FILTER (text_exists) AS text_exists, count(*) FILTER (desired AND NOT local_exists) AS needs_refetch, count(*) FILTER (local_path IS NOT NULL AND NOT local_exists AND NOT desired) AS stale_non_preserved FROM s GROUP BY ROLLUP (project)""")
def _(t: Tables):
    return agg.storage_audit(_flags(t), "project")


@query("e24_repair_plan", _STORE_SQL + """ SELECT project, root_name, action, count(*) AS n FROM (SELECT DISTINCT project, document_name AS root_name, CASE WHEN EXISTS (SELECT 1 FROM s x WHERE x.project = s.project AND x.document_name = s.document_name AND x.row_number = 1) THEN 'REFETCH' ELSE 'MISSING_FROM_LISTING' END AS action FROM s WHERE desired AND NOT local_exists
  UNION ALL SELECT project, document_name, 'MARK_DELETED' FROM s WHERE local_path IS NOT NULL AND NOT local_exists AND NOT desired) GROUP BY ALL""")
def _(t: Tables):
    flags = _flags(t)
    listing = flags.filter("row_number = 1").select("project", F.col("document_name").alias("root_name"))
    return agg.repair_plan(flags, listing, "project", "document_name").groupBy("project", "root_name", "action").agg(F.count(F.lit(1)).alias("n"))


@query("e11_project_completeness", cte("tenders", "lines") + """, d AS (SELECT project, count(*) AS documents, count(*) FILTER (unit IS NOT NULL) AS texts FROM lines GROUP BY project), m AS (SELECT project, count(*) AS merged_rows FROM lines WHERE row_number > 2 GROUP BY project)
  SELECT coalesce(d.project, m.project) AS project, coalesce(documents, 0) AS documents, coalesce(texts, 0) AS texts, coalesce(merged_rows, 0) AS merged_rows, coalesce(documents, 0) > 0 AND coalesce(texts, 0) > 0 AND coalesce(merged_rows, 0) > 0 AND coalesce(t.place <> 'ASIA' AND t.official, false) AS complete
  FROM d FULL JOIN m ON d.project = m.project LEFT JOIN tenders t ON t.tender_no = coalesce(d.project, m.project)""")
def _(t: Tables):
    docs = t.lines.select("project", F.col("unit").isNotNull().alias("has_text"))
    audit = t.tenders.select(F.col("tender_no").alias("project"), (F.col("place") != "ASIA").alias("amounts_ok"), F.col("official").alias("totals_ok"))
    return agg.project_completeness(docs, t.lines.filter("row_number > 2"), audit, "project").select("project", "documents", "texts", "merged_rows", "complete")


@query("e12_live_counts", cte("tenders", "lines", "runs") + """ SELECT (SELECT count(*) FROM tenders WHERE deadline_iso >= '2000-01-01') AS projects, (SELECT count(*) FROM runs WHERE day >= '2024-01-20') AS documents, (SELECT count(*) FROM runs WHERE day >= '2024-01-20' AND family <> 'error') AS text_docs,
  (SELECT count(*) FROM lines WHERE line_id >= 100000000000) AS merged_rows""")
def _(t: Tables):
    projects = t.tenders.select((F.col("deadline_iso") >= "2000-01-01").alias("first_seen_at"))
    docs = t.runs.select((F.col("day") >= "2024-01-20").alias("fetched_at"), (F.col("family") != "error").alias("has_text"))
    rows = t.lines.select((F.col("line_id") >= 100000000000).alias("extracted_at"))
    return agg.live_counts(projects, docs, rows, F.lit(True))


@query("e12_newest_projects", cte("tenders") + " SELECT tender_no, deadline_iso AS first_seen_at FROM tenders WHERE deadline_iso >= '2000-01-01' ORDER BY deadline_iso DESC, tender_no LIMIT 5")
def _(t: Tables):
    return agg.newest_projects(t.tenders.select("tender_no", F.col("deadline_iso").alias("first_seen_at")), F.lit("2000-01-01"), "tender_no", 5)


_STATE = "SELECT source_id, max(day) AS last_checked_at, CASE WHEN max(user_id) % 4 = 0 THEN 'CHANGED' WHEN max(user_id) % 4 = 1 THEN 'ERROR' ELSE 'SKIPPED_UNCHANGED' END AS last_status, CASE WHEN max(user_id) % 7 = 0 THEN 'slow' END AS last_error FROM {runs} WHERE day = '2024-01-15' GROUP BY source_id"
_CONF = "SELECT DISTINCT source_id, user_id % 2 = 0 AS selective FROM {runs} WHERE day = '2024-01-16'"
_HEALTH_SQL = """ r20 AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, run_no DESC) AS rn FROM runs), hs AS (SELECT source_id, count(*) AS c, count(*) FILTER (family = 'error') AS f, coalesce(min(rn) FILTER (family <> 'error') - 1, count(*)) AS k FROM r20 WHERE rn <= 20 GROUP BY source_id),
  health AS (SELECT source_id, c, f, k, CASE WHEN k >= 5 OR (c >= 10 AND f >= c * 0.8) THEN 'DISABLE_CANDIDATE' WHEN k >= 2 OR (c >= 5 AND f >= c * 0.4) THEN 'DEGRADED' WHEN f > 0 THEN 'WATCH' ELSE 'HEALTHY' END AS status FROM hs)"""


def health(t: Tables):
    return monitor.source_health(t.runs, "source_id", "ts", "run_no", F.col("family") == "error", 20)


_POLL_SQL = cte("runs") + f", s AS ({_STATE.format(runs='runs')}), c AS ({_CONF.format(runs='runs')})," + _HEALTH_SQL + """, p AS (SELECT coalesce(c.source_id, s.source_id) AS source_id, c.source_id IS NOT NULL AS conf, s.source_id IS NOT NULL AS tracked, coalesce(c.selective, false) AS sel, coalesce(s.last_status, 'NEVER_CHECKED') AS st, s.last_error AS er, s.last_checked_at, h.status AS hs
  FROM c FULL JOIN s ON s.source_id = c.source_id LEFT JOIN health h ON h.source_id = coalesce(c.source_id, s.source_id))"""


def polling(t: Tables):
    return agg.polling_rows(t.sql(_CONF), t.sql(_STATE), health(t))


@query("e13_polling_summary", _POLL_SQL + """ SELECT count(*) FILTER (conf) AS configured_total, count(*) FILTER (tracked) AS tracked_total, count(*) FILTER (st = 'CHANGED') AS changed_total, count(*) FILTER (st = 'CHANGED' AND sel) AS selective_changed_total, count(*) FILTER (st = 'SKIPPED_UNCHANGED') AS unchanged_total,
  count(*) FILTER (st = 'ERROR' OR er IS NOT NULL) AS error_total, count(*) FILTER (sel AND (st = 'ERROR' OR er IS NOT NULL)) AS selective_error_total, count(*) FILTER (st = 'REQUIRES_IDENTIFIER') AS requires_identifier_total, count(*) FILTER (st = 'NEVER_CHECKED') AS never_checked_total, count(*) FILTER (sel) AS selective_capable_total,
  count(*) FILTER (hs IN ('WATCH', 'DEGRADED', 'DISABLE_CANDIDATE')) AS health_warning_total, count(*) FILTER (hs = 'DISABLE_CANDIDATE') AS disable_candidate_total, max(last_checked_at) AS last_checked_at FROM p""")
def _(t: Tables):
    return agg.polling_summary(polling(t))


_AUDIT = "SELECT s_suppkey AS source, s_nationkey AS scope, CASE WHEN s_nationkey = 3 THEN 'FAILED' ELSE CASE s_suppkey % 5 WHEN 0 THEN 'REACHABLE' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'HTTP_ERROR' WHEN 3 THEN 'TEMPLATE_REQUIRES_IDENTIFIER' ELSE 'ADAPTER_READY' END END AS status, s_suppkey % 3 <> 0 AS adapter_required FROM {supplier}"
_AUDIT_SQL = f"WITH a AS ({_AUDIT.format(supplier='supplier')}), m AS (SELECT *, status IN ('FAILED', 'HTTP_ERROR') AND scope IN (SELECT scope FROM a WHERE status IN ('REACHABLE', 'ADAPTER_READY')) AS fb FROM a), f AS (SELECT *, adapter_required AND NOT fb AS need FROM m)"


@query("e14_audit_summary", _AUDIT_SQL + """ SELECT count(*) AS total, count(*) FILTER (status IN ('REACHABLE', 'ADAPTER_READY')) AS reachable, count(*) FILTER (status IN ('FAILED', 'HTTP_ERROR')) AS failed, count(*) FILTER (need) AS adapter_required, count(*) FILTER (status = 'TEMPLATE_REQUIRES_IDENTIFIER') AS templates,
  count(*) FILTER (status IN ('FAILED', 'HTTP_ERROR') AND fb) AS failed_with_fallback, count(*) FILTER (need AND NOT fb) AS unresolved_blockers FROM f""")
def _(t: Tables):
    return agg.audit_summary(agg.mark_fallbacks(t.sql(_AUDIT), "scope"))


@query("e14_mark_fallbacks", _AUDIT_SQL + " SELECT source, fb AS fallback_available, need AS adapter_required FROM f")
def _(t: Tables):
    return agg.mark_fallbacks(t.sql(_AUDIT), "scope").select("source", "fallback_available", "adapter_required")


@query("e15_batch_accounting", cte("tenders") + """, o AS (SELECT CASE WHEN place = 'ASIA' THEN 'skipped_invalid' WHEN segment = 'BUILDING' THEN 'skipped_existing' WHEN order_status = 'F' THEN 'failed' WHEN official THEN 'completed' ELSE 'partial' END AS outcome FROM tenders)
  SELECT count(*) AS candidates, count(*) FILTER (outcome = 'completed') AS completed, count(*) FILTER (outcome = 'partial') AS partial, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'skipped_existing') AS skipped_existing, count(*) FILTER (outcome = 'skipped_invalid') AS skipped_invalid, 'INCOMPLETE' AS status FROM o""")
def _(t: Tables):
    items = t.tenders.select((F.col("place") != "ASIA").alias("valid"), (F.col("segment") == "BUILDING").alias("existing_complete"), (F.col("order_status") != "F").alias("ok"), F.col("official").alias("complete"))
    return agg.batch_accounting(items)


def metrics(t: Tables):
    """One row of coverage metrics from the polling summary and the rows of a run."""
    poll = agg.polling_summary(polling(t)).select(
        F.col("configured_total").alias("sources_configured"), F.col("tracked_total").alias("sources_checked"), F.col("changed_total").alias("sources_changed"), F.col("error_total").alias("source_errors"),
        F.col("health_warning_total").alias("source_health_warnings"), F.lit(1).alias("_one"))
    rows = t.tenders.agg(F.count_if("official").alias("new_rows"), F.count_if(F.col("place") == "NOWHERE").alias("candidate_rows"), F.lit(0).alias("sent"), F.lit(False).alias("payment_scan_ok"), F.lit(1).alias("_one"))
    return poll.join(rows, "_one").drop("_one")


_METRICS_SQL = _POLL_SQL + ", e AS (SELECT count(*) FILTER (st = 'ERROR' OR er IS NOT NULL) AS errors, count(*) FILTER (hs IN ('WATCH', 'DEGRADED', 'DISABLE_CANDIDATE')) AS poor FROM p)"


@query("e16_monitoring_alerts", _METRICS_SQL + """ SELECT 'WARNING' AS severity, 'SOURCE_ERRORS' AS code, errors || ' source(s) reported errors in the latest polling state.' AS message FROM e UNION ALL SELECT 'WARNING', 'SOURCE_HEALTH_WARNINGS', poor || ' source(s) are degraded or need attention.' FROM e
  UNION ALL SELECT 'WARNING', 'ENTALMATA_SCAN_FAILED', 'Payment-order scan failed.' UNION ALL SELECT 'ERROR', 'EMAIL_NOT_SENT', 'New public-works rows existed but no email was sent.' UNION ALL SELECT 'WARNING', 'ZERO_PUBLIC_WORKS_CANDIDATES', 'Changed sources produced zero public-works dashboard candidates.'""")
def _(t: Tables):
    return agg.monitoring_alerts(metrics(t))


@query("e16_monitoring_status", _METRICS_SQL + " SELECT 'ERROR' AS status, 5::BIGINT AS alerts FROM e")
def _(t: Tables):
    return agg.monitoring_status(agg.monitoring_alerts(metrics(t)))


@query("e17_grid_metrics", """SELECT CAST(max(length(html)) AS INTEGER) AS declared_row_count, CAST(sum(len(regexp_extract_all(html, '<li>'))) AS BIGINT) AS rows_parsed FROM pages""")
def _(t: Tables):
    body = F.concat(F.lit('<t _rowCount="3" _rowCount="'), F.length("html").cast("string"), F.lit('">'), F.replace("html", F.lit("<li>"), F.lit('<TR class="x" role="row">')))
    return agg.grid_metrics(t.pages.select(body.alias("body")), "body")


_DEC = "SELECT deadline_iso >= '1998-07-03' AS in_window, segment <> 'BUILDING' AS has_document, place = 'ASIA' AS matched, deadline_iso < '1998-07-03' AND official AS archived FROM {tenders}"


@query("e18_scan_summary", cte("tenders") + f", d AS ({_DEC.format(tenders='tenders')})" + """ SELECT count(*) AS decisions_seen, count(*) FILTER (NOT in_window) AS outside_window, count(*) FILTER (in_window AND NOT has_document) AS without_document, count(*) FILTER (in_window AND has_document AND matched) AS matched,
  count(*) FILTER (in_window AND has_document AND NOT matched) AS rejected, count(*) FILTER (archived) AS archived FROM d""")
def _(t: Tables):
    return agg.scan_summary(t.sql(_DEC))


@query("e19_dashboard_summary", cte("tenders") + """ SELECT CASE WHEN segment = 'BUILDING' THEN 'ignored' WHEN deadline_iso < '1998-07-17' THEN 'expired' WHEN linked_id IS NOT NULL AND customer_no % 4 = 0 THEN 'duplicate' WHEN place = 'ASIA' THEN 'out_of_focus' ELSE 'visible' END AS stage, count(*) AS n FROM tenders GROUP BY 1""")
def _(t: Tables):
    c = F.col
    return agg.funnel(t.tenders, [("ignored", c("segment") == "BUILDING"), ("expired", c("deadline_iso") < "1998-07-17"), ("duplicate", c("linked_id").isNotNull() & (c("customer_no") % 4 == 0)), ("out_of_focus", c("place") == "ASIA")])


@query("e20_distinct_sorted", cte("tenders") + " SELECT DISTINCT customer_no, linked_id FROM tenders WHERE linked_id IS NOT NULL")
def _(t: Tables):
    return agg.distinct_ids(t.tenders.filter("linked_id is not null"), "customer_no", "linked_id")


_CAND = "SELECT source AS family, CASE WHEN place = 'ASIA' THEN ' ' ELSE CAST(customer_no AS STRING) END AS candidate_id FROM {tenders}"


@query("e23_source_families", cte("tenders") + f", c AS ({_CAND.format(tenders='tenders')})" + """, i AS (SELECT family, count(DISTINCT candidate_id) AS ids, count(*) AS items FROM c WHERE trim(candidate_id) <> '' GROUP BY family), e AS (SELECT source AS family, count(*) AS errors FROM tenders WHERE segment = 'BUILDING' AND source <> 'KIMDIS' GROUP BY 1),
  p AS (SELECT source AS family, count(*) AS pages, bool_or(source = 'KIMDIS' AND order_status = 'P') AS empty FROM tenders GROUP BY 1)
  SELECT p.family, coalesce(ids, 0) AS ids, coalesce(errors, 0) AS errors, pages, CASE WHEN p.family = 'ESHIDIS' THEN items < 2 * pages ELSE empty END AS exhausted FROM p LEFT JOIN i ON i.family = p.family LEFT JOIN e ON e.family = p.family""")
def _(t: Tables):
    errors = t.tenders.filter("segment = 'BUILDING' and source <> 'KIMDIS'").select(F.col("source").alias("family"))
    pages = t.tenders.select(F.col("source").alias("family"), F.when((F.col("source") == "KIMDIS") & (F.col("order_status") == "P"), 0).otherwise(5).alias("items_returned"), F.lit(2).alias("items_asked"))
    return agg.source_families(t.sql(_CAND), errors, pages, "ESHIDIS").select("family", "ids", "errors", "pages", "exhausted")


@query("e25_stage_summary", "SELECT event_type AS stage, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS ok, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables):
    s = agg.stage_summary(t.events.select(F.col("event_type").alias("stage"), F.col("props").alias("result")), ["k", "ok"])
    return s.groupBy("stage", "k", "ok").agg(F.count(F.lit(1)).alias("n"))


@query("e27_enrichment_summary", cte("tenders") + """ SELECT 20000::BIGINT AS targets, count(*) AS attempted, count(*) FILTER (linked_id IS NOT NULL) AS enriched, CAST(sum(CASE WHEN linked_id IS NOT NULL AND place = 'ASIA' THEN 1 ELSE 0 END) AS BIGINT) AS verified_links, count(*) FILTER (segment = 'BUILDING') AS failed, greatest(20000 - count(*), 0) AS remaining FROM tenders""")
def _(t: Tables):
    attempts = t.tenders.select((F.col("segment") != "BUILDING").alias("ok"), F.when(F.col("linked_id").isNotNull(), 1).otherwise(0).alias("linked_count"), F.when(F.col("linked_id").isNotNull() & (F.col("place") == "ASIA"), 1).otherwise(0).alias("verified_count"))
    return agg.enrichment_summary(attempts, F.lit(20000))
