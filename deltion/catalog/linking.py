"""Queries for joins (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltion.catalog.base import Tables, cte, query, sql_chars, sql_clean, sql_fold
from deltion.functions.codes import signature
from deltion.functions.text import fold_term
from deltion.operators import composite, links
from deltion.operators.ranking import document_rank
from deltion.rules import EvaluationRule, SearchProfile

RECIPIENTS = ["ann@example.org", " Bob@Example.org ", "eve@example.org"]

# Documents hang on tenders by their number; the source is the attachment's name.
_DOCS = "SELECT doc_id, doc_id AS attachment_id, text, lang AS document_type FROM {documents}"
_ATTS = "SELECT doc_id AS attachment_id, doc_id * 3 % 1500 AS tender_id, source || '.pdf' AS name, doc_id % 7 <> 0 AS is_latest FROM {documents}"
_TENDERS = "SELECT tender_no AS tender_id, official_id AS eshidis_id, title FROM {tenders}"
_DAT = cte("tenders") + f", d AS ({_DOCS.format(documents='documents')}), a AS ({_ATTS.format(documents='documents')}), t AS ({_TENDERS.format(tenders='tenders')})"


@query("d1_searchable_documents", _DAT + " SELECT doc_id, a.tender_id, t.eshidis_id, a.name FROM d JOIN a ON a.attachment_id = d.attachment_id JOIN t ON t.tender_id = a.tender_id WHERE d.text <> '' AND d.document_type IN ('en', 'fr')")
def _(t: Tables):
    return links.searchable_documents(t.sql(_DOCS), t.sql(_ATTS), t.sql(_TENDERS), ["en", "fr"]).select("doc_id", "tender_id", "eshidis_id", "name")


@query("d2_attachments_with_documents", _DAT + " SELECT a.attachment_id, a.name, d.document_type FROM a LEFT JOIN (SELECT * FROM d WHERE document_type <> 'de') d ON a.attachment_id = d.attachment_id WHERE a.is_latest")
def _(t: Tables):
    return links.attachments_with_documents(t.sql(_ATTS), t.sql(_DOCS).filter("document_type <> 'de'")).select("attachment_id", "name", "document_type")


@query("d3_rows_with_projects", cte("tenders", "lines") + " SELECT l.project, l.row_number, l.line_id, t.title, t.authority, t.deadline FROM lines l LEFT JOIN (SELECT * FROM tenders WHERE place <> 'ASIA') t ON t.tender_no = l.project")
def _(t: Tables):
    projects = t.tenders.filter("place <> 'ASIA'").select(F.col("tender_no").alias("project"), "title", "authority", "deadline")
    return links.rows_with_projects(t.lines.select("project", "row_number", "line_id"), projects, "project")


@query("d4_overlay_merge", cte("tenders") + """, x AS (SELECT customer_no, max(tender_no) FILTER (source = 'AUTHORITY') AS a, max(tender_no) FILTER (source = 'KIMDIS') AS n, max(tender_no) FILTER (source = 'ESHIDIS' AND order_status <> 'F') AS d,
    max(tender_no) FILTER (source = 'ESHIDIS' AND order_status = 'F') AS b FROM tenders GROUP BY customer_no)
  SELECT x.customer_no AS row_key, coalesce(CASE WHEN tb.segment <> 'BUILDING' THEN tb.title END, CASE WHEN d IS NOT NULL THEN td.title WHEN n IS NOT NULL THEN tn.title ELSE ta.title END) AS title,
    coalesce(tb.deadline, CASE WHEN d IS NOT NULL THEN td.deadline WHEN n IS NOT NULL THEN tn.deadline ELSE ta.deadline END) AS deadline,
    concat_ws('+', CASE WHEN a IS NOT NULL THEN 'a' END, CASE WHEN n IS NOT NULL THEN 'n' END, CASE WHEN d IS NOT NULL THEN 'd' END, CASE WHEN b IS NOT NULL THEN 'b' END) AS producers
  FROM x LEFT JOIN tenders ta ON ta.tender_no = a LEFT JOIN tenders tn ON tn.tender_no = n LEFT JOIN tenders td ON td.tender_no = d LEFT JOIN tenders tb ON tb.tender_no = b""")
def _(t: Tables):
    base = t.tenders.withColumn("row_key", F.col("customer_no"))
    empty_title = F.when(F.col("segment") == "BUILDING", "").otherwise(F.col("title"))
    official = F.col("source") == "ESHIDIS"
    return links.overlay_merge(
        base.filter("source = 'AUTHORITY'"), base.filter("source = 'KIMDIS'"), base.filter(official & (F.col("order_status") != "F")),
        base.filter(official & (F.col("order_status") == "F")).withColumn("title", empty_title), "row_key", ["title", "deadline"], "tender_no",
    )


_OVER = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'FORCE_KEEP' ELSE 'CONFIRM_DROP' END AS action FROM {labels} WHERE quality = 0"


@query("d5_attach_triage", cte("triage") + f", o AS ({_OVER.format(labels='labels')})" + """
  SELECT d.doc_id, t.decision, o.action AS override_action, t.decision IS NOT NULL AND NOT coalesce(t.keep, false) AND coalesce(o.action, '') <> 'FORCE_KEEP' AS triage_hidden FROM documents d LEFT JOIN triage t ON t.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id""")
def _(t: Tables):
    return links.attach_triage(t.documents.select("doc_id"), t.triage, t.sql(_OVER), "doc_id").select("doc_id", "decision", "override_action", "triage_hidden")


@query("d6_effective_overrides", """WITH g AS (SELECT doc_id, 'DROP' AS action, quality AS q FROM labels WHERE toxic = 0), u AS (SELECT doc_id, 'KEEP' AS action, 9 AS q FROM labels WHERE quality = 1)
  SELECT coalesce(u.doc_id, g.doc_id) AS doc_id, coalesce(u.action, g.action) AS action, CAST(CASE WHEN u.doc_id IS NOT NULL THEN u.q ELSE g.q END AS INTEGER) AS q, CASE WHEN u.doc_id IS NOT NULL THEN 'user' ELSE 'global' END AS scope FROM g FULL JOIN u ON u.doc_id = g.doc_id""")
def _(t: Tables):
    g = t.sql("SELECT doc_id, 'DROP' AS action, CAST(quality AS INT) AS q FROM {labels} WHERE toxic = 0")
    u = t.sql("SELECT doc_id, 'KEEP' AS action, 9 AS q FROM {labels} WHERE quality = 1")
    return links.effective_overrides(g, u, "doc_id", ["action", "q"])


@query("d7_drop_ignored", cte("tenders") + " SELECT tender_no FROM tenders WHERE NOT ((segment = 'BUILDING' OR (place = 'ASIA' AND NOT official)) AND NOT (place = 'ASIA' AND official))")
def _(t: Tables):
    overrides = t.sql("SELECT row_key, CASE WHEN official THEN 'FORCE_KEEP' ELSE 'CONFIRM_DROP' END AS action FROM {tenders} WHERE place = 'ASIA'")
    return links.drop_ignored(t.tenders, t.tenders.filter("segment = 'BUILDING'"), overrides, "row_key").select("tender_no")


_LOG = """SELECT row_key, CASE WHEN tender_no % 2 = 0 THEN 'email' ELSE 'sms' END AS channel, CASE tender_no % 3 WHEN 0 THEN 'ANN@example.org' WHEN 1 THEN 'bob@example.org' ELSE 'zoe@example.org' END AS recipient, deadline_iso AS sent_at FROM {tenders} WHERE segment <> 'BUILDING'"""


@query("d8_not_yet_notified", cte("tenders") + f", l AS ({_LOG.format(tenders='tenders')}), r(recipient) AS (VALUES ('ann@example.org'), ('bob@example.org'), ('eve@example.org'))" + """
  SELECT t.row_key, 'email' AS channel, r.recipient FROM tenders t, r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.row_key = t.row_key AND l.channel = 'email' AND lower(l.recipient) = r.recipient)""")
def _(t: Tables):
    return links.not_yet_notified(t.tenders.select("row_key"), RECIPIENTS, t.sql(_LOG))


@query("d9_documents_of_active_rows", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t: Tables):
    return links.documents_of_active_rows(t.documents.select("doc_id", "lang"), t.labels.filter("quality = 1"), "doc_id")


@query("d10_linked_ids_missing", cte("tenders") + " SELECT DISTINCT linked_id AS registry_id FROM tenders WHERE linked_id IS NOT NULL AND linked_id NOT IN (SELECT registry_id FROM tenders WHERE official)")
def _(t: Tables):
    rows = t.tenders.withColumn("ids", F.array_compact(F.array("linked_id", F.lit("n/a"))))
    return links.linked_ids_missing(rows, "ids", t.tenders.filter("official"), "registry_id")


_VERIFIED = "SELECT row_key, linked_id AS target_id FROM {tenders} WHERE linked_id IS NOT NULL AND segment = 'HOUSEHOLD'"
_DUPS = cte("tenders") + f", v AS ({_VERIFIED.format(tenders='tenders')})" + """, o AS (SELECT * FROM tenders WHERE official),
  j AS (SELECT t.row_key, t.tender_no, t.official, t.registry_id, o.registry_id AS target, v.target_id, (CAST(t.title = o.title AS INTEGER) + CAST(t.deadline = o.deadline AS INTEGER) + CAST(abs(t.budget - o.budget) <= 1 AS INTEGER) + CAST(t.authority = o.authority AS INTEGER)) AS signs
    FROM tenders t LEFT JOIN o ON o.registry_id = t.linked_id LEFT JOIN v ON v.row_key = t.row_key),
  k AS (SELECT *, NOT official AND target IS NOT NULL AND target_id IS NOT NULL AS vd, NOT official AND coalesce(signs, 0) >= 2 AS sd FROM j)"""


@query("d11_suppress_linked_duplicates", _DUPS + """, i AS (SELECT target_id, count(*) AS n FROM v GROUP BY target_id)
  SELECT k.row_key, CASE WHEN official THEN 'OFFICIAL_ESHIDIS_ROW' WHEN vd THEN 'REPLACED_BY_OFFICIAL_ESHIDIS' WHEN sd THEN 'STRONG_LINKED_ESHIDIS_DUPLICATE' WHEN k.target_id IS NOT NULL THEN 'VERIFIED_ESHIDIS_LINK_PENDING_OFFICIAL_ROW' ELSE 'NO_VERIFIED_ESHIDIS_LINK' END AS link_status,
    vd OR sd AS duplicate_hidden, CASE WHEN vd OR sd THEN target END AS duplicate_of, CASE WHEN official THEN coalesce(i.n, 0) ELSE 0 END AS inbound_links FROM k LEFT JOIN i ON i.target_id = k.registry_id""")
def _(t: Tables):
    rows = t.tenders.withColumn("linked_ids", F.array_compact(F.array("linked_id")))
    out = links.suppress_linked_duplicates(rows, t.sql(_VERIFIED))
    return out.select("row_key", "link_status", "duplicate_hidden", "duplicate_of", "inbound_links")


@query("d12_strong_duplicate", _DUPS + " SELECT row_key, coalesce(signs, 0) >= 2 AS strong FROM k WHERE target IS NOT NULL")
def _(t: Tables):
    fields = F.struct("title", "deadline", "budget", "authority")
    left = t.tenders.filter("linked_id is not null").select("row_key", F.col("linked_id").alias("registry_id"), fields.alias("l"))
    right = t.tenders.filter("official").select("registry_id", fields.alias("r"))
    return left.join(right, "registry_id").select("row_key", links.strong_duplicate(F.col("l"), F.col("r")).alias("strong"))


# Titles are the first sentences of documents; English ones are the official records.
_FUZZY = """SELECT doc_id, CAST(doc_id AS STRING) AS id, lang = 'en' AND doc_id % 2 = 0 AS official, split_part(text, '.', 1) AS title, CASE WHEN doc_id % 3 = 0 THEN source ELSE source || ' council' END AS authority, CASE WHEN doc_id % 5 = 0 THEN 'src' END AS place,
  CASE WHEN doc_id % 9 = 0 THEN CAST(doc_id - doc_id % 4 AS STRING) END AS linked_id, CAST(10000 + doc_id % 1000 AS STRING) AS deadline FROM {documents}"""
_T4 = "list_distinct(regexp_extract_all({}, '[a-zα-ω0-9]{{4,}}'))"


def _ov(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / least(len({a}), len({b})) ELSE 0.0::DOUBLE END"


@query("d13_fuzzy_best_match", f"""WITH f AS ({_FUZZY.format(documents='documents')}), g AS (SELECT *, {_T4.format(sql_fold('title'))} AS tok, {sql_fold('authority')} AS auth, {_T4.format(sql_fold('authority'))} AS atok FROM f),
  p AS (SELECT r.id AS row_key, o.id AS registry_id, o.deadline, {_ov('r.tok', 'o.tok')} AS ov, contains(o.auth, r.auth) OR contains(r.auth, o.auth) OR {_ov('r.atok', 'o.atok')} >= 0.5 AS am,
    coalesce(r.place IS NOT NULL AND contains(o.auth, r.place), false) AS pm, coalesce(r.linked_id = o.id, false) AS lm FROM g r JOIN g o ON o.official AND NOT r.official),
  s AS (SELECT *, least(ov * 0.62::DOUBLE + CASE WHEN am THEN 0.28::DOUBLE ELSE 0 END + CASE WHEN pm THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN lm THEN 0.5::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS score FROM p)
  SELECT row_key, max(round(score, 3)) AS score, arg_max(registry_id, (round(score, 3), deadline, registry_id)) AS registry_id FROM s WHERE score >= 0.72 GROUP BY row_key""")
def _(t: Tables):
    f = t.sql(_FUZZY)
    rows = f.filter("not official").select(F.col("id").alias("row_key"), "title", "authority", "place", F.array_compact(F.array("linked_id")).alias("linked_ids"))
    official = f.filter("official").select(F.col("id").alias("registry_id"), "title", "authority", "deadline")
    return links.fuzzy_best_match(rows, official).select("row_key", "score", "registry_id")


PROFILE = SearchProfile("words", exact_phrases=("that the", "der die", "de la"), optional_terms=("License", "nicht", "para"), revision_codes=("cc_by", "hein"))


def _terms_sql(profile: SearchProfile) -> str:
    rows = []
    for kind, confidence, terms in (("exact_phrase", 0.90, profile.exact_phrases), ("optional_term", 0.65, profile.optional_terms), ("revision_code", 0.60, profile.revision_codes)):
        rows += [f"('{kind}', '{x}', '{fold_term(x, underscores=True)}', {confidence}::DOUBLE)" for x in terms]
    return f"p(match_type, term, plain, confidence) AS (VALUES {', '.join(rows)})"


_MATCHES = f"""WITH d AS (SELECT doc_id, lang, flat, replace({sql_chars('flat')}, '_', ' ') AS f FROM (SELECT doc_id, lang, {sql_clean('text')} AS flat FROM documents)), {_terms_sql(PROFILE)},
  m AS (SELECT doc_id, lang, match_type, term, confidence, CAST(strpos(f, plain) AS INTEGER) AS pos, {sql_clean("substr(flat, CAST(greatest(strpos(f, plain) - 180, 1) AS INTEGER), CAST(strpos(f, plain) + length(plain) + 180 - greatest(strpos(f, plain) - 180, 1) AS INTEGER))")} AS context
    FROM d JOIN p ON contains(f, plain))"""


@query("d14_match_terms", _MATCHES + " SELECT doc_id, match_type, term, confidence, pos, context FROM m")
def _(t: Tables):
    return links.match_terms(t.documents, PROFILE, "text", "lang", ["doc_id"], dedupe=False)


RULES = [
    EvaluationRule("pair", phrases=("that the", "of the"), document_types=("en",), score=2.0),
    EvaluationRule("licence", phrases=("license", "licensed"), operator=">=", threshold=3.0, score=4.0, severity="important"),
    EvaluationRule("latin", phrases=("para", "de la", "nicht"), score=1.25),
]
_NUM = lambda c: f"""coalesce(list_min([x for x in [try_cast(replace(y, ',', '.') AS DOUBLE) for y in regexp_extract_all({c}, '[0-9]+[,.][0-9]+')] if x > 0 AND x < 1000]),
  list_min([x for x in [try_cast(CASE WHEN contains(y, ',') AND contains(y, '.') THEN replace(replace(y, '.', ''), ',', '.') ELSE replace(y, ',', '.') END AS DOUBLE) for y in regexp_extract_all({c}, '[0-9]+(?:[.,][0-9]+)*')] if x > 0 AND x < 1000]))"""  # noqa: E731


def _first(*phrases: str) -> str:
    return "least(" + ", ".join(f"nullif(strpos(f, '{p}'), 0)" for p in phrases) + ")"


def hits_sql() -> str:
    """CTE `h` of the rule hits of all documents."""
    cut = sql_clean("substr(flat, CAST(greatest(pos - 260, 1) AS INTEGER), CAST(pos + 260 - greatest(pos - 260, 1) AS INTEGER))")
    return f"""WITH d AS (SELECT doc_id, lang, source, flat, replace({sql_chars('flat')}, '_', ' ') AS f FROM (SELECT doc_id, lang, source, {sql_clean('text')} AS flat FROM documents) WHERE flat <> ''),
  c AS (SELECT doc_id, source, 'pair' AS rule_id, 2.0::DOUBLE AS score, {_first('that the', 'of the')} AS pos, flat FROM d WHERE lang = 'en' UNION ALL SELECT doc_id, source, 'licence', 4.0::DOUBLE, {_first('license', 'licensed')}, flat FROM d
    UNION ALL SELECT doc_id, source, 'latin', 1.25::DOUBLE, {_first('para', 'de la', 'nicht')}, flat FROM d),
  e AS (SELECT *, {cut} AS context FROM c WHERE pos IS NOT NULL),
  v AS (SELECT *, CASE WHEN rule_id = 'licence' THEN {_NUM("substr(context, CAST(greatest(strpos(lower(strip_accents(context)), 'license'), 1) AS INTEGER))")} END AS numeric_value FROM e),
  h AS (SELECT doc_id, source, rule_id, score, CAST(pos AS INTEGER) AS pos, numeric_value, context FROM v WHERE rule_id <> 'licence' OR numeric_value >= 3.0)"""


@query("d15_evaluate_rules", hits_sql() + " SELECT doc_id, rule_id, score, pos, numeric_value, context FROM h")
def _(t: Tables):
    return links.evaluate_rules(t.documents, RULES, "text", "lang", ["doc_id"]).select("doc_id", "rule_id", "score", "pos", "numeric_value", "context")


# Evidence documents of tenders, one stored and one legacy copy of some urls.
_EVID = """SELECT CAST(project AS STRING) AS row_key, source_document AS document_url, source_document AS name, CASE WHEN flag = 'N' THEN 0 ELSE 1 END AS origin, CASE WHEN flag = 'A' THEN CAST(part_no AS STRING) END AS linked,
  CASE WHEN flag = 'R' THEN '9999' ELSE '20' || CAST(10 + row_number AS STRING) || '-01-01' END AS deadline_key, document_no, line_id FROM {lines}"""


@query("d16_attach_document_evidence", cte("tenders", "lines") + f", e AS ({_EVID.format(lines='lines')})" + """,
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_key, document_url ORDER BY origin, name, line_id) AS rn FROM e) WHERE rn = 1),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY CASE document_no % 5 WHEN 1 THEN 1 ELSE CASE WHEN linked IS NOT NULL THEN 2 ELSE 3 END END, """ + sql_fold("name") + """, name) AS p FROM u) WHERE p <= 4),
  a AS (SELECT row_key, count(*) AS n, array_to_string(list_sort(list_distinct(list(linked) FILTER (linked IS NOT NULL))), ',') AS ids, max(nullif(deadline_key, '9999')) AS dl, string_agg(name, '|' ORDER BY p) AS names FROM b GROUP BY row_key)
  SELECT t.official_id AS row_key, coalesce(a.n, 0) AS document_evidence_count, CASE WHEN a.row_key IS NOT NULL THEN coalesce(a.ids, '') ELSE '' END AS linked_ids, a.names, CASE WHEN t.official THEN t.deadline ELSE a.dl END AS deadline
  FROM tenders t LEFT JOIN a ON a.row_key = t.official_id""")
def _(t: Tables):
    rows = t.sql("SELECT official_id AS row_key, CASE WHEN official THEN deadline ELSE '' END AS deadline FROM {tenders}").withColumn("linked_ids", F.array().cast("array<string>"))
    e = t.sql(_EVID).withColumn("linked_ids", F.array_compact(F.array("linked"))).withColumn("is_extension", F.lit(False)).withColumn("confidence", F.lit(0.75)).withColumn("deadline_at", F.col("deadline_key"))
    # The first line of a document stands for it.
    e = e.withColumn("origin", F.struct("origin", "name", "line_id"))
    out = links.attach_document_evidence(rows, e, document_rank(F.col("name"), F.lit(""), F.size("linked_ids") > 0), 4)
    names = F.array_join(F.transform("document_evidence", lambda d: d["name"]), "|")
    return out.select("row_key", "document_evidence_count", F.array_join(F.array_sort("linked_ids"), ",").alias("linked_ids"), names.alias("names"), "deadline")


@query("d17_official_deadlines", cte("tenders") + " SELECT t.customer_no, max(o.deadline_iso) AS linked_deadline FROM tenders t JOIN tenders o ON o.registry_id = t.linked_id GROUP BY t.customer_no")
def _(t: Tables):
    official = t.tenders.filter("official").select("registry_id", F.col("deadline_iso").alias("deadline_sort"))
    edges = t.tenders.filter("linked_id is not null").select("customer_no", F.col("linked_id").alias("registry_id"))
    return links.official_deadlines(official, edges, "customer_no")


@query("d18_enrichment_targets", cte("tenders") + """ SELECT t.row_key, CASE WHEN t.place = 'EUROPE' THEN t.row_key ELSE t.linked_id END AS identifier FROM tenders t LEFT JOIN tenders o ON o.registry_id = t.linked_id
  WHERE NOT t.official AND NOT (t.place <> 'EUROPE' AND o.registry_id IS NOT NULL) AND NOT (t.segment = 'BUILDING')""")
def _(t: Tables):
    ids = F.when(F.col("place") != "EUROPE", F.array_compact(F.array("linked_id"))).otherwise(F.array().cast("array<string>"))
    rows = t.tenders.withColumn("linked_ids", ids).withColumn("has_attachments", F.col("place") == "EUROPE").withColumn("display_order", F.col("tender_no"))
    rows = rows.withColumn("signature", signature(F.col("row_key"), F.col("title"), F.col("deadline")))
    changed = F.when(F.col("segment") == "BUILDING", F.col("signature")).otherwise("older")
    attempts = rows.filter("segment in ('BUILDING', 'FURNITURE')").select("row_key", changed.alias("signature"))
    return links.enrichment_targets(rows, attempts, t.tenders.filter("official")).select("row_key", "identifier")


_DOWN = "SELECT DISTINCT project AS tender_id, CASE WHEN flag = 'A' THEN source_document WHEN flag = 'N' THEN replace(source_document, ' ', '  ') ELSE 'other' END AS name FROM {lines}"
_ATTL = "SELECT project AS tender_id, source_document AS name, line_id AS id, flag <> 'R' OR row_number < 4 AS is_latest FROM {lines}"


@query("d19_match_by_name", cte("lines") + f", w AS ({_DOWN.format(lines='lines')}), a AS ({_ATTL.format(lines='lines')})" + """, e AS (SELECT tender_id, name, max(id) AS id FROM a WHERE is_latest GROUP BY ALL),
  n AS (SELECT tender_id, name AS plain, count(*) AS n, max(id) AS id FROM a WHERE is_latest GROUP BY ALL)
  SELECT w.tender_id, w.name, coalesce(e.id, n.id) AS attachment_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN n.id IS NOT NULL THEN 'normalized' ELSE 'missing' END AS matched_by FROM w LEFT JOIN e ON e.tender_id = w.tender_id AND e.name = w.name
  LEFT JOIN n ON n.tender_id = w.tender_id AND n.plain = regexp_replace(w.name, ' +', ' ', 'g') AND n.n = 1""")
def _(t: Tables):
    return links.match_by_name(t.sql(_DOWN), t.sql(_ATTL)).select("tender_id", "name", "attachment_id", "matched_by")


@query("d20_carry_forward", cte("tenders") + """ SELECT tender_no, 'now' AS notes FROM tenders WHERE source = 'ESHIDIS' UNION ALL SELECT tender_no, CASE WHEN official THEN 'x' ELSE 'old,SKIPPED_UNCHANGED cached from previous report' END FROM tenders WHERE source = 'KIMDIS'""")
def _(t: Tables):
    current = t.tenders.filter("source = 'ESHIDIS'").select("tender_no", "source", F.array(F.lit("now")).alias("match_notes"))
    previous = t.tenders.select("tender_no", "source", F.array(F.lit("old")).alias("match_notes"))
    skipped = t.tenders.filter("source = 'KIMDIS'").select("source").distinct()
    return links.carry_forward(current, previous, skipped, "source").select("tender_no", F.array_join("match_notes", ",").alias("notes"))


@query("d21_connected_references", cte("tenders") + """, c AS (SELECT customer_no, 'notices' AS act_type, 1 AS act_order, '26PROC' || official_id AS reference FROM tenders UNION ALL SELECT customer_no, 'payments', 6, '26pay' || official_id FROM tenders WHERE official UNION ALL SELECT customer_no, 'contracts', 5, 'old' || official_id FROM tenders WHERE NOT official)
  SELECT DISTINCT customer_no, act_type, CAST(act_order AS BIGINT) AS act_order, reference, CASE WHEN reference LIKE '26PROC%' THEN 'https://cerpp.eprocurement.gov.gr/khmdhs-opendata/notice/attachment/' || reference WHEN reference LIKE '26pay%' THEN 'https://cerpp.eprocurement.gov.gr/khmdhs-opendata/payment/attachment/' || reference END AS attachment_url FROM c""")
def _(t: Tables):
    chains = t.sql("""SELECT customer_no, map('notices', array('26PROC' || official_id, ' ', '26PROC' || official_id || ' '), 'payments', CASE WHEN official THEN array('26pay' || official_id) ELSE array() END,
      'contracts', CASE WHEN official THEN array('') ELSE array('old' || official_id) END, 'memos', array('m')) AS chain FROM {tenders}""")
    return links.connected_references(chains, F.col("chain"), "customer_no").select("customer_no", "act_type", "act_order", "reference", "attachment_url")


@query("d22_notification_rollup", cte("tenders", "runs") + """, s AS (SELECT user_id, count(DISTINCT family) AS recipients, max(day) AS last_sent_at FROM runs GROUP BY user_id)
  SELECT t.tender_no, coalesce(s.recipients, 0) AS recipients, s.last_sent_at FROM tenders t LEFT JOIN s ON s.user_id = t.tender_no""")
def _(t: Tables):
    log = t.runs.select(F.col("user_id").alias("tender_no"), F.col("family").alias("recipient"), F.col("day").alias("sent_at"))
    return links.notification_rollup(t.tenders.select("tender_no"), log, "tender_no")


@query("d23_composite_match", cte("tenders") + """, p AS (SELECT l.row_key, CAST(l.authority = r.authority AS INTEGER) + CAST(l.place = r.place AS INTEGER) + CAST(abs(l.budget - r.budget) <= greatest(l.budget, r.budget) * 0.01 AS INTEGER) + CAST(l.segment = r.segment AS INTEGER)
    + CAST(abs(date_diff('day', CAST(l.deadline_iso AS DATE), CAST(r.deadline_iso AS DATE))) <= 3 AS INTEGER) + CAST(l.order_status = r.order_status AS INTEGER) AS n FROM tenders l JOIN tenders r ON r.registry_id = l.linked_id)
  SELECT row_key, CAST(n AS INTEGER) AS agreements, CASE WHEN n >= 4 THEN 'STRONG_COMPOSITE_MATCH' WHEN n > 0 THEN 'POSSIBLY_RELATED' ELSE 'UNRELATED' END AS relation FROM p""")
def _(t: Tables):
    fields = F.struct("authority", "place", "budget", F.col("segment").alias("code"), F.col("deadline_iso").cast("date").alias("date"), F.col("order_status").alias("programme"))
    left = t.tenders.filter("linked_id is not null").select("row_key", F.col("linked_id").alias("registry_id"), fields.alias("l"))
    right = t.tenders.filter("official").select("registry_id", fields.alias("r"))
    return links.composite_match(left.join(right, "registry_id")).select("row_key", F.size("agreements").alias("agreements"), "relation")


def _composite_fields() -> dict:
    return {"authority": F.col("authority"), "place": F.col("place"), "budget": F.col("budget"), "code": F.col("segment"), "date": F.col("deadline_iso").cast("date"), "programme": F.col("order_status")}


_ALL_PAIRS = cte("tenders") + """, x AS MATERIALIZED (SELECT tender_no AS k, authority AS a, place AS p, CAST(round(budget * 100) AS BIGINT) AS b, segment AS c, CAST(deadline_iso AS DATE) AS d, order_status AS o FROM tenders),
  m AS (SELECT l.k AS lk, r.k AS rk, coalesce(l.a = r.a, false)::INT AS a, coalesce(l.p = r.p, false)::INT AS p, coalesce(l.c = r.c, false)::INT AS c, coalesce(l.o = r.o, false)::INT AS o, coalesce(100 * abs(l.b - r.b) <= greatest(l.b, r.b), false)::INT AS b, coalesce(abs(l.d - r.d) <= 3, false)::INT AS d FROM x l, x r WHERE l.k <> r.k),
  g AS (SELECT k, min(k) OVER (PARTITION BY a, p, b, c, d, o) AS class_id FROM x)"""


@query("d23_composite_links", _ALL_PAIRS + """ SELECT g.k AS tender_no, class_id, coalesce(n, 0) AS links, CASE WHEN n > 0 THEN 'STRONG_COMPOSITE_MATCH' ELSE 'UNRELATED' END AS relation
  FROM g LEFT JOIN (SELECT lk, count(*) AS n FROM m WHERE a + p + c + o + b + d >= 4 GROUP BY lk) s ON s.lk = g.k""")
def _(t: Tables):
    return composite.composite_links(t.tenders, "tender_no", **_composite_fields())


@query("d23_composite_pairs", _ALL_PAIRS + """ SELECT DISTINCT l.class_id, r.class_id AS other_id, concat_ws(',', CASE WHEN a = 1 THEN 'authority' END, CASE WHEN p = 1 THEN 'place' END, CASE WHEN c = 1 THEN 'code' END, CASE WHEN o = 1 THEN 'programme' END, 'budget', 'date') AS agreements
  FROM m JOIN g l ON l.k = lk JOIN g r ON r.k = rk WHERE b + d = 2 AND a + p + c + o >= 2 AND l.class_id < r.class_id""")
def _(t: Tables):
    pairs = composite.composite_pairs(t.tenders, "tender_no", **_composite_fields())
    return pairs.select("class_id", "other_id", F.array_join("agreements", ",").alias("agreements"))


@query("d24_document_preview", _DAT + f""" SELECT t.tender_id, a.attachment_id, CASE WHEN d.document_type = 'de' THEN 'budget' ELSE 'other' END AS kind, CASE WHEN d.document_type = 'de' THEN 'Προϋπολογισμός' ELSE 'Λοιπό αρχείο' END AS kind_label,
  CASE WHEN length({sql_clean('d.text')}) = 0 THEN NULL WHEN length({sql_clean('d.text')}) <= 420 THEN {sql_clean('d.text')} ELSE rtrim(substr({sql_clean('d.text')}, 1, 420)) || '...' END AS sample FROM t JOIN a ON a.tender_id = t.tender_id JOIN d ON d.attachment_id = a.attachment_id WHERE a.is_latest""")
def _(t: Tables):
    docs = t.sql(_DOCS).withColumn("document_type", F.when(F.col("document_type") == "de", "budget").otherwise("x"))
    return links.document_preview(t.sql(_TENDERS), t.sql(_ATTS), docs, "tender_id").select("tender_id", "attachment_id", "kind", "kind_label", "sample")


@query("d25_linked_ids_of", cte("tenders") + " SELECT DISTINCT customer_no, linked_id FROM tenders WHERE linked_id IS NOT NULL")
def _(t: Tables):
    return links.linked_ids_of(t.tenders.withColumn("ids", F.array_compact(F.array("linked_id"))), "customer_no", "ids")


_TERM_ORDER = "[" + ", ".join(f"'{x}'" for x in (*PROFILE.exact_phrases, *PROFILE.optional_terms, *PROFILE.revision_codes)) + "]"


def deduped_sql(extra: str = "") -> str:
    """CTE `u`: the matches that are left of each document when near-equal evidence is folded, one match after the other."""
    words = f"list_distinct(list_filter(string_split({sql_clean("replace(" + sql_chars('context') + ", '_', ' ')")}, ' '), lambda w: w <> ''))"
    near = "y.match_type = q.x.match_type AND coalesce(len(list_intersect(y.w, q.x.w)) / nullif(least(len(y.w), len(q.x.w)), 0) >= 0.7, false)"
    return _MATCHES.replace("WITH d", "WITH RECURSIVE d", 1) + f""",
  q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_position({_TERM_ORDER}, term)) AS k, struct_pack(match_type := match_type, term := term, confidence := confidence, pos := pos, w := {words}) AS x FROM m {extra}),
  r AS (SELECT doc_id, 1::BIGINT AS k, [x] AS kept FROM q WHERE k = 1
    UNION ALL SELECT z.doc_id, z.k, CASE WHEN z.spot IS NULL THEN list_append(z.kept, z.x) WHEN (z.x.confidence, length(z.x.term)) > (z.kept[z.spot].confidence, length(z.kept[z.spot].term)) THEN list_transform(z.kept, lambda y, i: CASE WHEN i = z.spot THEN z.x ELSE y END) ELSE z.kept END
      FROM (SELECT q.doc_id, q.k, q.x, r.kept, nullif(list_position(list_transform(r.kept, lambda y: {near}), true), 0) AS spot FROM r JOIN q ON q.doc_id = r.doc_id AND q.k = r.k + 1) z),
  u AS (SELECT doc_id, unnest(arg_max(kept, k)) AS y FROM r GROUP BY doc_id)"""


@query("f9_dedupe_similar", deduped_sql() + " SELECT doc_id, y.match_type AS match_type, y.term AS term, y.confidence AS confidence FROM u")
def _(t: Tables):
    return links.match_terms(t.documents, PROFILE, "text", "lang", ["doc_id"]).select("doc_id", "match_type", "term", "confidence")
