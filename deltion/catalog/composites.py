"""Queries for the user-facing compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltion.catalog.aggregating import _POLL_SQL, polling
from deltion.catalog.base import Tables, cte, query, sql_fold
from deltion.catalog.linking import _ATTS, _DAT, _DOCS, _T4, _TENDERS, PROFILE, RULES, _ov, deduped_sql, hits_sql
from deltion.plans import dashboard as dash
from deltion.plans import discovery
from deltion.rules import AmbiguousAlias, Scope, SearchProfile, UserProfile
from deltion.session import settle

L, D = "long", "double"
AS_OF = "1998-07-17"

_GATE = {"works": ["building", "machinery", "household"], "tender": ["site 1"], "admin": ["site 39"], "supply": ["furniture"], "general": []}
_SCOPES = [Scope("East", ("asia", "middle east municipality"), (AmbiguousAlias("NATION_7", ("site 1",), ("site 2",)),)), Scope("Europe", ("nation 3", "nation_13 municipality"))]


def _producers(t: Tables):
    cols = ["source", "record_type", "official_id", "title", "authority", "status", "seq"]
    base = t.tenders.withColumn("seq", F.col("tender_no")).withColumn("status", F.when(F.col("deadline_iso") > AS_OF, "SUBMISSION_OPEN_CANDIDATE").otherwise("SUBMISSION_EXPIRED_CANDIDATE"))
    base = base.withColumn("title", F.concat_ws(" ", "title", "place"))
    official = base.filter("official").select(*cols)
    again = base.filter("official and segment = 'BUILDING'").withColumn("title", F.lit("later copy")).withColumn("seq", F.col("seq") + 10**9).select(*cols)
    feed = base.filter("NOT official").withColumn("attachment_url", F.when(F.col("source") == "KIMDIS", F.lit("https://x/a.pdf"))).select(*cols, "attachment_url")
    return [official, again, feed]


_K1 = cte("tenders") + """, f AS (SELECT *, lower(source || ' ' || record_type || ' ' || official_id || ' ' || title || ' ' || place || ' ' || authority || CASE WHEN source = 'KIMDIS' THEN ' https://x/a.pdf' ELSE '' END) AS f FROM tenders),
  g AS (SELECT *, CASE WHEN official THEN 'KEEP_PUBLIC_WORKS_TENDER' WHEN contains(f, 'site 39') AND NOT contains(f, 'site 1') THEN 'DROP_ADMIN' WHEN segment = 'FURNITURE' THEN 'DROP_OUT_OF_SCOPE_SUPPLY_SERVICE'
      WHEN segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND (contains(f, 'site 1') OR record_type = 'PROC' OR source = 'KIMDIS') THEN 'KEEP_PUBLIC_WORKS_CANDIDATE' WHEN segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'REVIEW_PUBLIC_WORKS_SIGNAL' ELSE 'DROP_NOT_PUBLIC_WORKS' END AS decision,
    concat_ws(',', CASE WHEN list_contains(regexp_extract_all(f, '[a-z0-9α-ω]+'), 'asia') THEN 'East' WHEN contains(f, 'nation 7') AND NOT contains(f, 'site 2') THEN 'East' END, CASE WHEN contains(f, 'nation 3') OR contains(f, 'nation 13 municipality') THEN 'Europe' END) AS scopes FROM f)"""


@query("k1_expanded_candidates", _K1 + " SELECT official_id, source, decision, decision NOT LIKE 'DROP%' AS keep, scopes FROM g")
def _(t: Tables):
    rows = discovery.expanded_candidates(_producers(t), _SCOPES, _GATE)
    return rows.select("official_id", "source", F.col("gate.decision").alias("decision"), "keep", F.array_join(F.transform("scope_matches", lambda s: s["scope"]), ",").alias("scopes"))


@query("k1_cached_sources", _K1 + """ SELECT official_id, source, decision, decision NOT LIKE 'DROP%' AS keep, scopes, CASE WHEN source = 'KIMDIS' THEN 'SKIPPED_UNCHANGED cached from previous report' ELSE '' END AS notes FROM g""")
def _(t: Tables):
    official, again, feed = _producers(t)
    previous = feed.filter("source = 'KIMDIS'").withColumn("match_notes", F.array().cast("array<string>"))
    skipped = t.spark.createDataFrame([("KIMDIS",), ("OTHER",)], "source string")
    rows = discovery.expanded_candidates([official, again, feed.filter("source <> 'KIMDIS'")], _SCOPES, _GATE, previous=previous, skipped=skipped)
    return rows.select("official_id", "source", F.col("gate.decision").alias("decision"), "keep", F.array_join(F.transform("scope_matches", lambda s: s["scope"]), ",").alias("scopes"), F.array_join("match_notes", "|").alias("notes"))


@query("k1_expanded_summary", _K1 + f""", s AS (SELECT *, scopes <> '' AS foc, decision NOT LIKE 'DROP%' AS kp, deadline_iso > '{AS_OF}' AS opn FROM g) SELECT count(*) AS total_candidates, count(*) FILTER (foc AND kp) AS focus_candidates, count(*) FILTER (source = 'ESHIDIS') AS eshidis_candidates, count(*) FILTER (source = 'KIMDIS') AS kimdis_candidates,
  count(*) FILTER (source = 'AUTHORITY') AS authority_candidates, count(*) FILTER (foc AND kp AND record_type = 'PROC' AND opn) AS focus_open_proc, count(*) FILTER (foc AND kp AND source = 'AUTHORITY') AS focus_authority, count(*) FILTER (foc AND NOT kp) AS focus_filtered_non_public_works,
  count(*) FILTER (foc AND record_type = 'PROC' AND NOT opn) AS focus_expired_proc, count(*) FILTER (foc AND record_type IN ('AWRD', 'SYMV')) AS focus_historical, 3::BIGINT AS errors FROM s""")
def _(t: Tables):
    return discovery.expanded_summary(discovery.expanded_candidates(_producers(t), _SCOPES, _GATE), F.lit(3))


# A dashboard over the tenders: dismissed, overridden, labelled and linked ones, and places of interest.
_TOWNS = [Scope("NATION_7 municipality")]
_REGIONS = [Scope("East", units=("asia",)), Scope("Europe", units=("europe",))]


def inputs(t: Tables) -> dash.Inputs:
    # The view is joined once and written; all inputs of a dashboard are read from that table.
    tenders = settle(t.tenders)
    rows = tenders.select(
        "row_key", "source", "official", "official_id", "registry_id", "title", "authority", "place", "budget",
        F.when(~F.col("official") & (F.col("segment") == "HOUSEHOLD"), "").otherwise(F.col("deadline")).alias("deadline"), F.array_compact(F.array("linked_id")).alias("linked_ids"))
    return dash.Inputs(
        rows=rows, dismissed=tenders.filter("order_status = 'P' and segment = 'MACHINERY'").select("row_key"),
        overrides=t.sql("SELECT row_key, CASE WHEN official THEN 'FORCE_KEEP' ELSE 'CONFIRM_DROP' END AS action FROM {tenders} WHERE order_status = 'P' AND place = 'EUROPE'", tenders=tenders),
        triage=t.sql("SELECT row_key, CASE WHEN segment = 'FURNITURE' THEN 'DROP_ADMIN' ELSE 'KEEP_ACTIVE_TENDER' END AS decision, CAST(0.8 AS DOUBLE) AS confidence, segment <> 'FURNITURE' AS keep FROM {tenders} WHERE order_status <> 'O'", tenders=tenders),
        links=t.sql("SELECT row_key, linked_id AS target_id FROM {tenders} WHERE linked_id IS NOT NULL AND segment = 'AUTOMOBILE'", tenders=tenders), towns=_TOWNS, regions=_REGIONS, taxonomy=[])


_DASH = cte("tenders") + f""", o AS (SELECT * FROM tenders WHERE official),
  a AS (SELECT t.*, CASE WHEN t.order_status = 'P' AND t.place = 'EUROPE' THEN CASE WHEN t.official THEN 'FORCE_KEEP' ELSE 'CONFIRM_DROP' END END AS action, t.order_status = 'P' AND t.segment = 'MACHINERY' AS dismissed, CASE WHEN t.order_status <> 'O' THEN CASE WHEN t.segment = 'FURNITURE' THEN 'DROP_ADMIN' ELSE 'KEEP_ACTIVE_TENDER' END END AS decision,
      NOT t.official AND t.segment = 'HOUSEHOLD' AS undated, o.registry_id AS target, o.deadline_iso AS o_deadline, o.title AS o_title, o.authority AS o_authority, o.budget AS o_budget FROM tenders t LEFT JOIN o ON o.registry_id = t.linked_id),
  b AS (SELECT *, (dismissed OR coalesce(action = 'CONFIRM_DROP', false)) AND coalesce(action, '') <> 'FORCE_KEEP' AS ignored, coalesce(decision = 'DROP_ADMIN', false) AND coalesce(action, '') <> 'FORCE_KEEP' AS triage_hidden,
      NOT official AND target IS NOT NULL AND (segment = 'AUTOMOBILE' OR CAST(title = o_title AS INTEGER) + CAST(NOT undated AND deadline_iso = o_deadline AS INTEGER) + CAST(abs(budget - o_budget) <= 1 AS INTEGER) + CAST(authority = o_authority AS INTEGER) >= 2) AS dup,
      CASE WHEN authority = 'NATION_7 municipality' THEN 'NATION_7 municipality' WHEN place = 'ASIA' THEN 'East - asia' WHEN place = 'EUROPE' THEN 'Europe - europe' END AS reason FROM a),
  oi AS (SELECT registry_id, ignored AS oig FROM b WHERE official), e AS (SELECT b.*, CASE WHEN NOT undated THEN deadline_iso WHEN target IS NOT NULL AND NOT oi.oig THEN o_deadline END AS eff FROM b LEFT JOIN oi ON oi.registry_id = b.target),
  s AS (SELECT *, CASE WHEN ignored THEN 'ignored' WHEN dup THEN 'duplicate' WHEN eff IS NULL OR eff < '{AS_OF}' THEN 'expired' WHEN triage_hidden THEN 'triage' WHEN reason IS NULL THEN 'out_of_focus' ELSE 'visible' END AS stage FROM e)"""


@query("k2_dashboard", _DASH + """ SELECT row_key, eff AS deadline_sort, reason AS interest_reason, CAST(budget AS DOUBLE) AS budget, CASE WHEN official THEN 'ESHIDIS:' || registry_id WHEN linked_id IS NOT NULL THEN 'ESHIDIS:' || linked_id END AS canonical_key FROM s WHERE stage = 'visible' AND budget >= 100000 AND NOT contains(title, 'site 13')""")
def _(t: Tables):
    profile = UserProfile("ann@example.org", exclude=("site 13",), min_budget=100000.0)
    rows = dash.dashboard(inputs(t), F.lit(AS_OF).cast("date"), profile)
    return rows.select("row_key", F.substring("deadline_sort", 1, 10).alias("deadline_sort"), "interest_reason", F.col("budget").cast(D).alias("budget"), F.col("identity.canonical_key").alias("canonical_key"))


@query("k2_dashboard_funnel", _DASH + " SELECT stage, count(*) AS n FROM s GROUP BY stage")
def _(t: Tables):
    return dash.dashboard_funnel(inputs(t), F.lit(AS_OF).cast("date"))


@query("k3_hidden_audit", _DASH + f""" , h AS (SELECT row_key, 'DISMISSED' AS category, action FROM s WHERE dismissed AND coalesce(action, '') <> 'FORCE_KEEP' UNION ALL SELECT row_key, 'AI_DROP_ADMIN', action FROM s WHERE NOT ignored AND triage_hidden UNION ALL SELECT row_key, 'DUPLICATE', action FROM s WHERE NOT ignored AND dup
  UNION ALL SELECT row_key, CASE WHEN eff IS NULL THEN 'NO_DEADLINE_EVIDENCE' ELSE 'EXPIRED' END, action FROM s WHERE NOT ignored AND NOT dup AND NOT triage_hidden AND reason IS NOT NULL AND (eff IS NULL OR eff < '{AS_OF}'))
  SELECT row_key, category, CASE WHEN action = 'CONFIRM_DROP' THEN NULL WHEN category = 'NO_DEADLINE_EVIDENCE' THEN 'MEDIUM' WHEN category = 'AI_DROP_ADMIN' THEN 'HIGH' END AS review_priority FROM h""")
def _(t: Tables):
    return dash.hidden_audit(inputs(t), F.lit(AS_OF).cast("date"), fuzzy=False).select("row_key", "category", "review_priority")


_LIKE = _DASH + f""", w AS (SELECT *, {_T4.format(sql_fold('title'))} AS tok, {sql_fold('authority')} AS auth, {_T4.format(sql_fold('authority'))} AS atok, {sql_fold('reason')} AS place_of FROM s),
  und AS (SELECT * FROM w WHERE NOT ignored AND NOT dup AND NOT triage_hidden AND reason IS NOT NULL AND eff IS NULL), off AS (SELECT * FROM w WHERE official AND NOT ignored AND NOT dup),
  sc AS (SELECT l.row_key, least({_ov('l.tok', 'r.tok')} * 0.62::DOUBLE + CASE WHEN contains(r.auth, l.auth) OR contains(l.auth, r.auth) OR {_ov('l.atok', 'r.atok')} >= 0.5 THEN 0.28::DOUBLE ELSE 0 END + CASE WHEN contains(r.auth, l.place_of) THEN 0.12::DOUBLE ELSE 0 END
    + CASE WHEN coalesce(l.linked_id = r.registry_id, false) THEN 0.5::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS score FROM und l, off r WHERE NOT l.official),
  lk AS (SELECT DISTINCT row_key FROM sc WHERE score >= 0.72),
  h AS (SELECT row_key, 'AI_DROP_ADMIN' AS category, 'HIGH' AS review_priority, action FROM s WHERE NOT ignored AND triage_hidden
    UNION ALL SELECT row_key, CASE WHEN row_key IN (SELECT row_key FROM lk) THEN 'DUPLICATE_CANDIDATE' ELSE 'NO_DEADLINE_EVIDENCE' END, 'MEDIUM', action FROM und)"""


@query("k3_hidden_audit_fuzzy", _LIKE + " SELECT row_key, category, review_priority FROM h WHERE coalesce(action, '') <> 'CONFIRM_DROP'")
def _(t: Tables):
    hidden = dash.hidden_audit(inputs(t), F.lit(AS_OF).cast("date"))
    return dash.review_queue(hidden.withColumn("at", F.col("effective_deadline")), "at").select("row_key", "category", "review_priority")


@query("k4_reverse_search", _DASH + """ , v AS (SELECT * FROM s WHERE stage = 'visible'), m AS (SELECT row_key, 'metadata' AS kind, 'Στοιχεία έργου' AS label FROM v WHERE contains(lower(title), 'site 1')
    UNION ALL SELECT v.row_key, 'document', d.source FROM v JOIN documents d ON v.tender_no = d.doc_id WHERE contains(lower(d.text), 'site 1'))
  SELECT row_key, kind, label FROM m""")
def _(t: Tables):
    rows = dash.visible_rows(inputs(t), F.lit(AS_OF).cast("date"))
    docs = t.sql("SELECT t.row_key, d.source AS name, d.text FROM {documents} d JOIN {tenders} t ON t.tender_no = d.doc_id")
    return dash.reverse_search(rows, docs, "Site 1", None, None).select("row_key", "kind", "label")


@query("k4_reverse_search_documents", _DASH + """ , v AS (SELECT * FROM s WHERE stage = 'visible'), m AS (SELECT v.row_key, d.source AS label FROM v JOIN documents d ON v.tender_no = d.doc_id WHERE contains(lower(strip_accents(d.text)), 'er')) SELECT row_key, 'document' AS kind, label FROM m""")
def _(t: Tables):
    rows = dash.visible_rows(inputs(t), F.lit(AS_OF).cast("date"))
    docs = t.sql("SELECT t.row_key, d.source AS name, d.text FROM {documents} d JOIN {tenders} t ON t.tender_no = d.doc_id")
    return dash.reverse_search(rows, docs, "ér", None, None).filter("kind = 'document'").select("row_key", "kind", "label")


_K5 = deduped_sql("WHERE lang IN ('en', 'fr')").replace(", d AS (", ", dd AS (")


@query("k5_search_profile", _K5 + ", " + _DAT.removeprefix("WITH ").replace("d AS (", "dx AS (") + """ SELECT 'run-1' AS run_id, t.eshidis_id, u.doc_id, y.match_type AS match_type, y.term AS term, y.confidence AS confidence,
  CAST(to_json(struct_pack(profile_id := 'words', term := y.term, match_type := y.match_type, pos := y.pos, document_type := dx.document_type, original_name := a.name)) AS VARCHAR) AS provenance
  FROM u JOIN dx ON dx.doc_id = u.doc_id JOIN a ON a.attachment_id = dx.attachment_id JOIN t ON t.tender_id = a.tender_id""")
def _(t: Tables):
    profile = SearchProfile(PROFILE.profile_id, document_types=("en", "fr"), exact_phrases=PROFILE.exact_phrases, optional_terms=PROFILE.optional_terms, revision_codes=PROFILE.revision_codes)
    return discovery.search_profile(t.sql(_DOCS), t.sql(_ATTS), t.sql(_TENDERS), profile, "run-1").select("run_id", "eshidis_id", "doc_id", "match_type", "term", "confidence", "provenance")


@query("k6_evaluate_profile", hits_sql() + ", " + _DAT.removeprefix("WITH ").replace(", d AS (", ", dd AS (") + """, r AS (SELECT t.eshidis_id, h.rule_id, h.score, count(*) AS n FROM h JOIN dd ON dd.doc_id = h.doc_id AND dd.text <> '' JOIN a ON a.attachment_id = dd.attachment_id JOIN t ON t.tender_id = a.tender_id GROUP BY ALL)
  SELECT eshidis_id, CAST(round(sum(CAST(score AS DECIMAL(18,4)) * n), 2) AS DOUBLE) AS total_score, CAST(sum(n) AS BIGINT) AS hit_count, string_agg(rule_id || 'x' || n, ',' ORDER BY score DESC, rule_id) AS rules FROM r GROUP BY eshidis_id""")
def _(t: Tables):
    scores = discovery.evaluate_profile(t.sql(_DOCS), t.sql(_ATTS), t.sql(_TENDERS), RULES)
    return scores.select("eshidis_id", F.col("total_score").cast(D).alias("total_score"), "hit_count", "rules")


@query("k8_explain_row", _DASH + """, i AS (SELECT linked_id AS registry_id, count(*) AS n FROM tenders WHERE linked_id IS NOT NULL AND segment = 'AUTOMOBILE' GROUP BY 1)
  SELECT row_key, CASE WHEN official AND coalesce(i.n, 0) > 0 THEN 'CANONICAL_WITH_LINKED_SOURCES' WHEN official THEN 'CANONICAL_SOURCE' WHEN segment = 'AUTOMOBILE' THEN 'VERIFIED_ESHIDIS_LINK' ELSE 'EXTRACTED_ESHIDIS_LINK' END AS merge_status,
    source || ' ' || official_id || CASE WHEN linked_id IS NOT NULL THEN '|ΕΣΗΔΗΣ ' || linked_id ELSE '' END AS sources, CAST(2 + CAST(reason IS NOT NULL AS INTEGER) + CAST(eff IS NOT NULL AS INTEGER) + CAST(decision IS NOT NULL AS INTEGER) AS INTEGER) AS reasons,
    concat_ws('|', 'Έγγραφα=pending', CASE WHEN action IS NOT NULL THEN 'Feedback=' || action END, CASE WHEN eff IS NOT NULL THEN 'Cleanup=scheduled' END) AS operations,
    concat_ws('|', 'Εντοπισμός', CASE WHEN reason IS NOT NULL THEN 'Φίλτρο ενδιαφέροντος' END, 'ΕΣΗΔΗΣ', CASE WHEN eff IS NOT NULL THEN 'Προθεσμία' END, CASE WHEN decision IS NOT NULL THEN 'AI έλεγχος' END, CASE WHEN action IS NOT NULL THEN 'Feedback' END) AS timeline FROM s LEFT JOIN i ON i.registry_id = s.registry_id""")
def _(t: Tables):
    rows = dash.explain_rows(dash.prepared(inputs(t)))
    joined = lambda c, f: F.array_join(F.transform(c, f), "|").alias(c)
    return rows.select(
        "row_key", "merge_status", F.array_join("sources", "|").alias("sources"), F.size("why_visible").alias("reasons"),
        joined("operations", lambda x: F.concat_ws("=", x["label"], x["text"])), joined("timeline", lambda x: x["label"]))


_PEOPLE = [UserProfile("Ann@example.org", exclude=("site 13",), min_budget=100000.0), UserProfile("bob@example.org", include=("site 2",)), UserProfile("eve@example.org")]
_FRESH = _DASH + """, v AS (SELECT * FROM s WHERE stage = 'visible'), q AS (SELECT *, 'ann@example.org' AS recipient FROM v WHERE budget >= 100000 AND NOT contains(title, 'site 13') UNION ALL SELECT *, 'bob@example.org' FROM v WHERE contains(title, 'site 2') UNION ALL SELECT *, 'eve@example.org' FROM v),
  n AS (SELECT * FROM q WHERE NOT (segment = 'BUILDING' AND recipient = 'ann@example.org'))"""


def _digest(t: Tables):
    rows = dash.visible_rows(inputs(t), F.lit(AS_OF).cast("date"))
    log = t.tenders.filter("segment = 'BUILDING'").select("row_key", F.lit("email").alias("channel"), F.lit(" ANN@example.org").alias("recipient"))
    return dash.digest(rows, _PEOPLE, log, [], F.lit(AS_OF).cast("date"))


@query("k9_digest", _FRESH + " SELECT recipient, row_key FROM n")
def _(t: Tables):
    return _digest(t)[0].select("recipient", "row_key")


@query("k9_digest_attention", _FRESH + f""", z AS (SELECT recipient, row_key, budget, row_number() OVER (PARTITION BY recipient ORDER BY budget DESC, row_key) AS rn, eff FROM n)
  SELECT recipient, 'Λήγουν σύντομα' AS bucket, count(*) AS n FROM z WHERE eff BETWEEN '{AS_OF}' AND '1998-07-24' GROUP BY 1 UNION ALL SELECT recipient, 'Χωρίς έγγραφα', count(*) FROM z GROUP BY 1 UNION ALL SELECT recipient, 'Υψηλότεροι προϋπολογισμοί', count(*) FROM z WHERE rn <= 3 GROUP BY 1""")
def _(t: Tables):
    return _digest(t)[1].groupBy("recipient", "bucket").agg(F.count(F.lit(1)).alias("n"))


_DECISIONS = """SELECT place AS org, CAST(year(CAST(deadline_iso AS DATE)) * -1 AS INT) AS page, row_key AS ada, CAST(deadline_iso AS DATE) AS issue_date, CASE WHEN segment = 'MACHINERY' THEN '' ELSE 'u' END AS document_url, title AS text,
  CASE WHEN official THEN 'VISIBLE' ELSE 'REJECTED' END AS previous_status FROM {tenders}"""


_ORDERS = cte("tenders") + f", d AS ({_DECISIONS.format(tenders='tenders').replace('AS INT)', 'AS INTEGER)')})" + """, pg AS (SELECT org, page, bool_and(issue_date < DATE '1999-06-17') AS out FROM d GROUP BY ALL), stp AS (SELECT org, min(page) FILTER (out) AS stop FROM pg GROUP BY org),
  r AS (SELECT d.*, issue_date >= DATE '1999-06-17' AS in_window, document_url <> '' AS has_document, contains(lower(text), 'building') OR contains(lower(text), 'site 7') AS hit FROM d JOIN stp ON stp.org = d.org WHERE stop IS NULL OR page <= stop),
  x AS (SELECT *, CASE WHEN in_window AND has_document THEN CASE WHEN hit THEN 'VISIBLE' ELSE 'REJECTED' END ELSE previous_status END AS st FROM r),
  y AS (SELECT *, CASE WHEN st = 'VISIBLE' AND NOT in_window THEN 'ARCHIVED' ELSE st END AS status, st = 'VISIBLE' AND NOT in_window AS archived FROM x)"""


@query("k11_payment_orders", _ORDERS + " SELECT ada, in_window, has_document, hit AS matched, status, archived FROM y")
def _(t: Tables):
    rows = discovery.payment_orders(t.sql(_DECISIONS), _KEYWORDS, F.lit("1999-07-01").cast("date"))
    return rows.select("ada", "in_window", "has_document", "matched", "status", "archived")


_KEYWORDS = ["BUILDING", "Site 7"]


def _order_report(t: Tables):
    return discovery.payment_order_report(t.sql(_DECISIONS).withColumn("fetched_at", F.col("issue_date")), _KEYWORDS, F.lit("1999-07-01").cast("date"))


@query("k11_scan_summary", _ORDERS + """ SELECT count(*) AS decisions_seen, count(*) FILTER (NOT in_window) AS outside_window, count(*) FILTER (in_window AND NOT has_document) AS without_document, count(*) FILTER (in_window AND has_document AND hit) AS matched,
  count(*) FILTER (in_window AND has_document AND NOT hit) AS rejected, count(*) FILTER (archived) AS archived FROM y""")
def _(t: Tables):
    return _order_report(t)["summary"]


@query("k11_recent_orders", _ORDERS + " SELECT ada, issue_date FROM y WHERE status = 'VISIBLE'")
def _(t: Tables):
    return _order_report(t)["recent"].select("ada", "issue_date")


def _order_rows(t: Tables):
    recent = _order_report(t)["recent"]
    orders = recent.select("ada", F.when(F.col("org") == "ASIA", F.col("text")).alias("project_title"), F.lit("7").alias("protocol"), "issue_date", F.col("text").alias("subject"), "document_url", "matched_keywords")
    log = recent.filter("org = 'EUROPE'").select(F.concat(F.lit("ENTALMA:"), "ada").alias("row_key"), F.lit("orders_email").alias("channel"), F.lit("Bob@example.org ").alias("recipient"))
    return dash.digest_orders(orders, [p.user for p in _PEOPLE], log)


_ORDER_ROWS = _ORDERS + """, po AS (SELECT y.*, r.recipient FROM y, (VALUES ('ann@example.org'), ('bob@example.org'), ('eve@example.org')) r(recipient) WHERE status = 'VISIBLE' AND NOT (org = 'EUROPE' AND r.recipient = 'bob@example.org'))"""


@query("k9_digest_orders", _ORDER_ROWS + """ SELECT recipient, 'ENTALMA:' || ada AS row_key, CASE WHEN org = 'ASIA' THEN text ELSE 'ΕΝΤΟΛΗ ΠΛΗΡΩΜΗΣ 7-' || strftime(issue_date, '%Y-%m-%d') END AS title FROM po""")
def _(t: Tables):
    return _order_rows(t).select("recipient", "row_key", "title")


@query("k9_digest_summary", _FRESH + _ORDER_ROWS.removeprefix(cte("tenders")) + """, z AS (SELECT r.recipient, (SELECT count(*) FROM n WHERE n.recipient = r.recipient) AS a, (SELECT count(*) FROM po WHERE po.recipient = r.recipient) AS b FROM (VALUES ('ann@example.org'), ('bob@example.org'), ('eve@example.org')) r(recipient))
  SELECT recipient, a AS new_count, b AS new_order_count, CASE WHEN a + b = 0 THEN 'καμία νέα ειδοποίηση' ELSE concat_ws(', ', CASE WHEN a > 0 THEN a || ' νέα έργα' END, CASE WHEN b > 0 THEN b || ' νέα εντάλματα' END) END AS subject FROM z""")
def _(t: Tables):
    return dash.digest_summary(_digest(t)[0], _order_rows(t), [p.user for p in _PEOPLE])


def _run(t: Tables):
    rows = t.tenders.agg(F.count_if("official").alias("new_rows"), F.count(F.lit(1)).alias("candidate_rows"), F.lit(1).alias("sent"))
    return discovery.run_report(polling(t), rows)


@query("k12_run_report", _POLL_SQL + """, e AS (SELECT count(*) FILTER (st = 'ERROR' OR er IS NOT NULL) AS errors, count(*) FILTER (hs IN ('WATCH', 'DEGRADED', 'DISABLE_CANDIDATE')) AS poor FROM p) SELECT 'WARNING' AS severity, 'SOURCE_ERRORS' AS code, errors || ' source(s) reported errors in the latest polling state.' AS message FROM e
  UNION ALL SELECT 'WARNING', 'SOURCE_HEALTH_WARNINGS', poor || ' source(s) are degraded or need attention.' FROM e""")
def _(t: Tables):
    return _run(t)["alerts"]


@query("k12_run_status", _POLL_SQL + " SELECT 'WARNING' AS status, CAST(2 AS BIGINT) AS alerts FROM (SELECT count(*) FROM p)")
def _(t: Tables):
    return _run(t)["status"]
