"""Queries for projections, filters and predicates (C*) and in-row labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltion.catalog.base import Tables, cte, query, sql_any, sql_clean, sql_fold, sql_hits
from deltion.functions.numbers import compare_op
from deltion.functions.text import any_alias, matched_terms, norm_text, tokens
from deltion.operators import filters
from deltion.rules import AmbiguousAlias, Scope, UserProfile


DICT = ["with", "für", "nicht", "para", "une", "license", "theron", "mentre", "that the", "der die", "cion", "esth"]
_DOC = f"WITH d AS (SELECT doc_id, lang, source, text, n_chars, {sql_fold('text')} AS f, regexp_extract_all({sql_fold('text')}, '[a-z0-9α-ω]+') AS tok FROM documents)"
_PLAIN = [w.replace("ü", "u") for w in DICT]


@query("c2_matched_terms", _DOC + f" SELECT doc_id, {sql_hits('f', _PLAIN, DICT)} AS terms FROM d")
def _(t: Tables):
    folded = norm_text(F.col("text"))
    return t.documents.select("doc_id", folded.alias("f")).select("doc_id", F.array_join(matched_terms(F.col("f"), _PLAIN, DICT), ",").alias("terms"))


@query("c3_alias_match", _DOC + """ SELECT doc_id, list_contains(tok, 'an') AS short_alias, list_contains(tok, 'theron') OR contains(' ' || f || ' ', ' theron ') AS long_alias, contains(f, 'der die') AS phrase FROM d""")
def _(t: Tables):
    docs = t.documents.select("doc_id", norm_text(F.col("text")).alias("f")).select("doc_id", "f", tokens(F.col("f")).alias("tok"))
    f, tok = F.col("f"), F.col("tok")
    return docs.select("doc_id", any_alias(f, tok, ["an"]).alias("short_alias"), any_alias(f, tok, ["theron"]).alias("long_alias"), any_alias(f, tok, ["Der, die"]).alias("phrase"))


SCOPES = [
    Scope("North", ("that the", "und"), (AmbiguousAlias("mente", ("de la",), ("une",)),)),
    Scope("South", ("para el",), (AmbiguousAlias("une", ("leux", "du"), ("para",)), AmbiguousAlias("ha", ("thon",), ("esth",)))),
]
_TOK = lambda w: f"list_contains(tok, '{w}')"


@query("c4_scope_match", _DOC + f""", m AS (SELECT doc_id,
    CASE WHEN contains(f, 'that the') OR {_TOK('und')} THEN 'North:' WHEN {_TOK('mente')} AND NOT {_TOK('une')} THEN CASE WHEN contains(f, 'de la') THEN 'North:ambiguous alias confirmed by context: mente' ELSE 'North:ambiguous alias retained for review: mente' END END AS a,
    CASE WHEN contains(f, 'para el') THEN 'South:' WHEN {_TOK('une')} AND NOT {_TOK('para')} THEN CASE WHEN {_TOK('leux')} OR {_TOK('du')} THEN 'South:ambiguous alias confirmed by context: une' ELSE 'South:ambiguous alias retained for review: une' END
      WHEN {_TOK('ha')} AND NOT {_TOK('esth')} THEN CASE WHEN {_TOK('thon')} THEN 'South:ambiguous alias confirmed by context: ha' ELSE 'South:ambiguous alias retained for review: ha' END END AS b FROM d)
  SELECT doc_id, concat_ws('|', a, b) AS scopes FROM m""")
def _(t: Tables):
    found = filters.scope_match(F.col("text"), SCOPES)
    return t.documents.select("doc_id", F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["scope"], s["note"])), "|").alias("scopes"))


TOWNS = [Scope("Town Ü", ("theronen", "cc by"), (AmbiguousAlias("entin", ("the of",), ("stre",)),))]
AREAS = [Scope("Area", units=("der die", "une")), Scope("Wide", nuts=("el64",))]
_B = lambda w: f"regexp_matches(f, '(^|[^0-9a-zα-ω]){w}($|[^0-9a-zα-ω])')"


@query("c5_focus_location", _DOC + f"""
  SELECT doc_id, CASE WHEN {_B('town u')} OR contains(f, 'theronen') OR {_B('cc by')} THEN 'Town Ü' WHEN contains(f, 'entin') AND NOT contains(f, 'stre') THEN CASE WHEN {_B('the of')} THEN 'Town Ü' ELSE 'Town Ü (ασαφές τοπωνύμιο: entin)' END
    WHEN {_B('der die')} OR {_B('une')} THEN 'Area - der die, une' WHEN contains(f, 'wide') OR contains(f, 'el64') THEN 'Wide' END AS reason FROM d""")
def _(t: Tables):
    return t.documents.select("doc_id", filters.focus_location(F.col("text"), TOWNS, AREAS).alias("reason"))


_W, _T, _A, _SUP, _GEN = ["erth", "cion", "keit", "leux"], ["license", "para", "theron"], ["copyright", "hein"], ["esth", "mentre"], ["leux"]


@query("c6_works_gate", _DOC + f""", g AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'ESHIDIS' ELSE 'AUTHORITY' END AS src, CASE WHEN doc_id % 7 = 0 THEN 'PROC' ELSE 'WEB' END AS rt, doc_id % 5 = 0 AS att FROM d),
  k AS (SELECT *, CASE WHEN src = 'ESHIDIS' THEN 'KEEP_PUBLIC_WORKS_TENDER' WHEN {sql_any('f', _A)} AND NOT {sql_any('f', _T)} THEN 'DROP_ADMIN'
    WHEN {sql_any('f', _SUP)} AND NOT {sql_any('f', _W[:3])} THEN 'DROP_OUT_OF_SCOPE_SUPPLY_SERVICE' WHEN {sql_any('f', _W)} AND ({sql_any('f', _T)} OR rt = 'PROC' OR att) THEN 'KEEP_PUBLIC_WORKS_CANDIDATE'
    WHEN {sql_any('f', _W)} THEN 'REVIEW_PUBLIC_WORKS_SIGNAL' ELSE 'DROP_NOT_PUBLIC_WORKS' END AS decision FROM g)
  SELECT doc_id, decision, decision NOT LIKE 'DROP%' AS keep, {sql_hits('f', _W)} AS works_terms, {sql_hits('f', _T)} AS tender_terms,
    CASE decision WHEN 'DROP_ADMIN' THEN {sql_hits('f', _A)} WHEN 'DROP_OUT_OF_SCOPE_SUPPLY_SERVICE' THEN {sql_hits('f', _SUP)} ELSE '' END AS drop_terms FROM k""")
def _(t: Tables):
    docs = t.documents.select("doc_id", norm_text(F.col("text")).alias("f"))
    source = F.when(F.col("doc_id") % 10 == 0, "ESHIDIS").otherwise("AUTHORITY")
    kind = F.when(F.col("doc_id") % 7 == 0, "PROC").otherwise("WEB")
    gate = filters.works_gate(F.col("f"), source, kind, F.col("doc_id") % 5 == 0, _W, _T, _A, _SUP, _GEN)
    g = docs.select("doc_id", gate.alias("g"))
    return g.select("doc_id", "g.decision", "g.keep", *[F.array_join(f"g.{c}", ",").alias(c) for c in ("works_terms", "tender_terms", "drop_terms")])


@query("c7_notice_status", cte("tenders") + """
  SELECT tender_no, CASE WHEN record_type = 'AWRD' THEN 'HISTORICAL_AWARD_RECORD' WHEN record_type = 'SYMV' THEN 'HISTORICAL_CONTRACT_RECORD' WHEN segment = 'FURNITURE' THEN 'CANCELLED_NOTICE'
    WHEN segment = 'MACHINERY' THEN 'UNKNOWN_DEADLINE_CANDIDATE' WHEN deadline_iso > '1998-07-17' THEN 'SUBMISSION_OPEN_CANDIDATE' ELSE 'SUBMISSION_EXPIRED_CANDIDATE' END AS status FROM tenders""")
def _(t: Tables):
    raw = t.sql("SELECT tender_no, record_type, segment = 'FURNITURE' AS cancelled, CASE WHEN segment = 'MACHINERY' THEN 'later' ELSE deadline_iso || 'T23:00:00' END AS raw FROM {tenders}")
    return raw.select("tender_no", filters.notice_status(F.col("record_type"), F.col("cancelled"), F.col("raw"), F.lit("1998-07-17").cast("date")).alias("status"))


@query("c8_classify_document_name", cte("lines") + """
  SELECT project, row_number, line_id, CASE document_no % 5 WHEN 0 THEN 'budget' WHEN 1 THEN 'financial_offer_form' WHEN 2 THEN 'other' WHEN 3 THEN 'price_list' ELSE 'other' END AS document_type,
    CASE WHEN document_no % 5 IN (2, 4) THEN 0.2 ELSE 0.95 END::DOUBLE AS confidence FROM lines""")
def _(t: Tables):
    named = t.lines.select("project", "row_number", "line_id", filters.classify_name(F.col("source_document")).alias("c"))
    return named.select("project", "row_number", "line_id", "c.document_type", "c.confidence")


_ATT = """SELECT tender_no, CASE tender_no % 4 WHEN 0 THEN 'Κατακύρωση_' WHEN 1 THEN 'ΔΙΑΚΗΡΥΞΗ ' WHEN 2 THEN 'Παράταση και Ορθή  επανάληψη ' ELSE 'σχέδιο ' END || official_id || '.pdf' AS name,
  CASE tender_no % 4 WHEN 1 THEN 'tender_declaration' WHEN 3 THEN CASE WHEN official THEN 'contract' ELSE 'other' END ELSE 'other' END AS document_type, title || ' μέχρι την κατακύρωση και τη σύμβαση' AS body, deadline, official FROM {tenders}"""
_SIG = """ s AS (SELECT tender_no, unnest(CASE tender_no % 4 WHEN 0 THEN ['final_award/true', 'cancellation/true'] WHEN 1 THEN ['procedural_mention/false', 'procedural_mention/false'] WHEN 2 THEN ['extension/true', 'correction/true']
    ELSE CASE WHEN official THEN ['contract/true'] ELSE [] END END) AS s FROM tenders)"""


@query("c9_status_signals", cte("tenders") + "," + _SIG + " SELECT tender_no, string_split(s, '/')[1] AS signal_type, string_split(s, '/')[2] = 'true' AS decisive, count(*) AS n FROM s GROUP BY ALL")
def _(t: Tables):
    rows = filters.status_signals(t.sql(_ATT), "tender_no", "name", "document_type", "body")
    return rows.groupBy("tender_no", "signal_type", "decisive").agg(F.count(F.lit(1)).alias("n"))


@query("c10_recommend_status", cte("tenders") + "," + _SIG + """, x AS (SELECT tender_no, bool_or(s LIKE '%true') AS decisive, count(*) AS n FROM s GROUP BY tender_no)
  SELECT t.tender_no, CASE WHEN decisive THEN 'UNKNOWN' WHEN deadline_iso >= '1998-07-17' THEN 'POSSIBLY_ACTIVE' ELSE 'SUBMISSION_EXPIRED' END AS recommended_status,
    CAST(CASE WHEN decisive THEN 0.35 WHEN deadline_iso >= '1998-07-17' THEN 0.65 ELSE 0.7 END AS DOUBLE) AS status_confidence, coalesce(n, 0) AS signal_count FROM tenders t LEFT JOIN x ON x.tender_no = t.tender_no""")
def _(t: Tables):
    att = t.sql(_ATT)
    signals = filters.status_signals(att, "tender_no", "name", "document_type", "body")
    now = F.to_timestamp(F.lit("1998-07-17 10:00:00"))
    return filters.recommend_status(att.select("tender_no", "deadline"), signals, "tender_no", "deadline", now).select("tender_no", "recommended_status", "status_confidence", "signal_count")


@query("c11_active_filter", cte("tenders") + """
  SELECT tender_no, CASE WHEN segment IN ('FURNITURE', 'MACHINERY') THEN NULL ELSE deadline END AS effective, segment NOT IN ('FURNITURE', 'MACHINERY') AND deadline_iso >= '1998-07-17' AS active FROM tenders""")
def _(t: Tables):
    raw = t.sql("""SELECT tender_no, CASE WHEN segment = 'BUILDING' THEN deadline ELSE '' END AS own, CASE WHEN segment = 'HOUSEHOLD' THEN deadline END AS linked,
      CASE WHEN segment IN ('FURNITURE', 'MACHINERY') THEN NULL ELSE deadline END AS evidence FROM {tenders}""")
    effective = filters.effective_deadline(F.col("own"), F.col("linked"), F.col("evidence"))
    return raw.select("tender_no", effective.alias("effective"), filters.is_active(effective, F.lit("1998-07-17").cast("date")).alias("active"))


PROFILES = [
    UserProfile("ann@example.org", include=("site 1", "Building"), exclude=("site 13",), min_budget=100000.0),
    UserProfile("bob@example.org", category_ids=("cat_a",), max_budget=250000.0),
    UserProfile("eve@example.org"),
]
TAX = [
    {"id": "cat_a", "label": "A works", "polarity": "positive", "weight": 2, "cpv": ["452"], "strong": ["that the", "keit"], "medium": ["erth", "cion"]},
    {"id": "cat_b", "label": "B works", "polarity": "positive", "weight": 2, "cpv": [], "strong": ["leux"], "medium": ["para", "une", "ist"]},
    {"id": "cat_n", "label": "N out", "polarity": "negative", "weight": 3, "cpv": ["33"], "strong": ["license"], "medium": ["hein", "mentre"]},
]


@query("c12_user_profile_match", cte("tenders") + f""", x AS (SELECT *, {sql_fold("title || ' ' || authority")} AS f, segment = 'BUILDING' AS cat_a, CASE WHEN place = 'ASIA' THEN NULL ELSE budget END AS b FROM tenders)
  SELECT tender_no, 'ann@example.org' AS recipient, (contains(f, 'site 1') OR contains(f, 'building')) AND NOT contains(f, 'site 13') AND coalesce(b >= 100000, true) AS matches FROM x
  UNION ALL SELECT tender_no, 'bob@example.org', cat_a AND coalesce(b <= 250000, true) FROM x UNION ALL SELECT tender_no, 'eve@example.org', true FROM x""")
def _(t: Tables):
    from deltion.rules import for_each_rule

    label = F.struct(F.lit("cat_a").alias("id"), F.lit("A works").alias("label"), F.lit("positive").alias("polarity"))
    rows = t.tenders.select("tender_no", norm_text(F.concat_ws(" ", "title", "authority")).alias("f"), F.when(F.col("place") != "ASIA", F.col("budget").cast("double")).alias("b"),
                            F.when(F.col("segment") == "BUILDING", F.array(label)).otherwise(F.filter(F.array(label), lambda x: F.lit(False))).alias("labels"))

    def match(p: UserProfile):
        m = filters.user_profile_match(F.col("f"), F.col("labels"), F.col("b"), p)
        return F.struct(F.lit(p.user).alias("recipient"), m["matches"].alias("matches"))

    return for_each_rule(rows, PROFILES, match, ["tender_no"])


@query("c13_confidence_band", cte("triage") + """
  SELECT doc_id, CASE WHEN keep AND confidence >= 0.9 THEN 'SURE_MATCH' WHEN keep AND confidence >= 0.75 THEN 'LIKELY_MATCH' WHEN keep THEN 'NEEDS_REVIEW' WHEN confidence >= 0.9 THEN 'SURE_DROP'
    WHEN confidence >= 0.75 THEN 'LIKELY_DROP' ELSE 'NEEDS_REVIEW' END AS band FROM triage""")
def _(t: Tables):
    return t.triage.select("doc_id", filters.confidence_band(F.col("keep"), F.col("confidence")).alias("band"))


@query("c14_compare_threshold", """
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_totalprice > 250000 WHEN 1 THEN o_totalprice >= 250000 WHEN 2 THEN o_totalprice < 250000 WHEN 3 THEN o_totalprice <= 250000 WHEN 4 THEN o_totalprice = 250000 ELSE false END AS passed FROM orders""")
def _(t: Tables):
    op = F.element_at(F.array(*[F.lit(o) for o in (">", ">=", "<", "<=", "==", "~")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t.orders.select("o_orderkey", compare_op(F.col("o_totalprice"), op, F.lit(250000.0)).alias("passed"))


@query("c15_open_notice_filter", cte("tenders") + "SELECT tender_no FROM tenders WHERE source = 'KIMDIS' AND record_type = 'PROC' AND deadline_iso > '1998-07-17' AND place <> 'ASIA'")
def _(t: Tables):
    rows = t.sql("""SELECT tender_no, source, record_type, official_id, CASE WHEN deadline_iso > '1998-07-17' THEN 'SUBMISSION_OPEN_CANDIDATE' ELSE 'SUBMISSION_EXPIRED_CANDIDATE' END AS status,
      CASE WHEN place = 'ASIA' THEN '' ELSE 'https://x/' || official_id END AS attachment_url FROM {tenders}""")
    return filters.open_notice_filter(rows).select("tender_no")


@query("c16_drop_landing_rows", """SELECT page_id, url FROM pages WHERE NOT (rtrim(lower(url), '/') LIKE '%.html' OR rtrim(lower(url), '/') LIKE '%=feed')""")
def _(t: Tables):
    rows = t.pages.select("page_id", "url", F.lit("x").alias("title"))
    return filters.drop_landing_rows(rows, "title", "url", suffixes=(".html", "=feed")).select("page_id", "url")


@query("c17_text_quality_flags", f"""
  SELECT doc_id, lang = 'es' OR length({sql_clean('text')}) < 200 AS needs_ocr, length(text) > 0 OR lang = 'fr' AS skip FROM documents""")
def _(t: Tables):
    status = F.when(F.col("lang") == "es", "NO_TEXT_FOUND").when(F.col("lang") == "fr", "UNSUPPORTED_TYPE").otherwise("TEXT_EXTRACTED")
    return t.documents.select("doc_id", filters.needs_ocr(status, F.col("text"), 200).alias("needs_ocr"), filters.skip_analysis(status, F.col("text")).alias("skip"))


@query("c18_hidden_category", cte("triage") + """
  SELECT doc_id, CASE decision WHEN 'DROP_ADMIN' THEN 'AI_DROP_ADMIN' WHEN 'DROP_OUT_OF_SCOPE_SUPPLY_SERVICE' THEN 'AI_DROP_SUPPLY_SERVICE' WHEN 'DROP_NOT_PUBLIC_WORKS' THEN 'AI_DROP_NOT_PUBLIC_WORKS' ELSE 'AI_HIDDEN' END AS category,
    'AI έλεγχος: ' || CASE decision WHEN 'DROP_ADMIN' THEN 'διοικητική/μη διαγωνιστική πράξη' WHEN 'DROP_OUT_OF_SCOPE_SUPPLY_SERVICE' THEN 'προμήθεια ή υπηρεσία εκτός δημοσίων έργων' WHEN 'DROP_NOT_PUBLIC_WORKS' THEN 'όχι δημόσιο έργο κατασκευής'
      ELSE 'μη κατάλληλο για την καθημερινή λίστα' END || CASE WHEN quality = 1 THEN '. good' ELSE '.' END AS reason FROM triage""")
def _(t: Tables):
    return t.triage.select("doc_id", filters.hidden_category(F.col("decision")).alias("category"), filters.hidden_reason(F.col("decision"), F.when(F.col("quality") == 1, " good ")).alias("reason"))


_REVIEW = """SELECT tender_no, CASE tender_no % 7 WHEN 0 THEN 'NO_DEADLINE_EVIDENCE' WHEN 1 THEN 'DUPLICATE_CANDIDATE' WHEN 2 THEN 'AI_DROP_SUPPLY_SERVICE' WHEN 3 THEN 'AI_DROP_ADMIN' WHEN 4 THEN 'OUT_OF_SCOPE_SUPPLY_SERVICE' WHEN 5 THEN 'EXPIRED' ELSE 'AI_DROP_NOT_PUBLIC_WORKS' END AS category,
    CASE tender_no % 7 WHEN 2 THEN 'DROP_OUT_OF_SCOPE_SUPPLY_SERVICE' WHEN 6 THEN 'DROP_NOT_PUBLIC_WORKS' ELSE 'DROP_ADMIN' END AS decision, CAST(tender_no % 20 AS DOUBLE) / 20 + 0.05 AS confidence,
    CASE segment WHEN 'BUILDING' THEN 'διαγωνισμός ' WHEN 'FURNITURE' THEN 'έργο ' WHEN 'MACHINERY' THEN 'προμήθεια καυσίμων, έργο ' ELSE '' END || title AS title, segment, official FROM {tenders}"""


@query("c19_review_priority", cte("tenders") + """, r AS (SELECT *, tender_no % 7 AS m, CAST(tender_no % 20 AS DOUBLE) / 20 + 0.05 AS conf, segment = 'MACHINERY' AS oos, segment IN ('BUILDING', 'FURNITURE', 'MACHINERY') AS signal FROM tenders)
  SELECT tender_no, CASE m WHEN 0 THEN CASE WHEN oos THEN NULL WHEN segment = 'BUILDING' THEN 'HIGH' ELSE 'MEDIUM' END WHEN 1 THEN 'MEDIUM' WHEN 3 THEN CASE WHEN conf < 0.9 THEN 'HIGH' ELSE 'LOW' END
    WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE CASE WHEN conf < 0.9 THEN 'HIGH' WHEN signal THEN CASE WHEN oos THEN NULL ELSE 'HIGH' END ELSE 'MEDIUM' END END AS priority FROM r""")
def _(t: Tables):
    rows = t.sql(_REVIEW)
    oos = filters.out_of_scope_reason(F.col("title"), F.lit(""))
    p = filters.review_priority(F.col("category"), F.col("decision"), F.col("confidence"), F.col("title"), F.lit(""), oos, F.lit(False))
    return rows.select("tender_no", p.alias("priority"))


_ROADISH = """SELECT tender_no, official_id, budget, deadline, segment, CASE segment WHEN 'BUILDING' THEN 'Διαγωνισμός: προμήθεια καυσίμων για συντήρηση οδικού δικτύου ' WHEN 'FURNITURE' THEN 'Προμήθεια λιπαντικών ' WHEN 'MACHINERY' THEN 'Μεταφορά μαθητών '
    WHEN 'HOUSEHOLD' THEN 'Σύστημα τηλεελέγχου ' ELSE 'Σχολείο ' END || title AS t FROM {tenders}"""


@query("c20_out_of_scope_reason", cte("tenders") + """
  SELECT tender_no, CASE segment WHEN 'FURNITURE' THEN 'καυσίμων' WHEN 'MACHINERY' THEN 'μαθητών' WHEN 'HOUSEHOLD' THEN 'τηλεελέγχου' END AS about FROM tenders""")
def _(t: Tables):
    reason = filters.out_of_scope_reason(F.col("t"), F.col("official_id"))
    return t.sql(_ROADISH).select("tender_no", F.nullif(F.regexp_extract(reason, "(?U)(καυσίμων|μαθητών|τηλεελέγχου)", 1), F.lit("")).alias("about"))


@query("c21_triage_guard", cte("tenders") + """
  SELECT tender_no, CASE WHEN tender_no % 3 = 0 THEN 'REVIEW_TENDER_CANDIDATE' WHEN tender_no % 3 = 1 THEN CASE WHEN segment = 'BUILDING' THEN 'REVIEW_TENDER_CANDIDATE' ELSE 'DROP_OUT_OF_SCOPE_SUPPLY_SERVICE' END ELSE 'KEEP_ACTIVE_TENDER' END AS decision,
    CAST(CASE WHEN tender_no % 3 = 0 THEN 1.0 WHEN tender_no % 3 = 1 THEN CASE WHEN segment = 'BUILDING' THEN 0.74 ELSE 0.95 END ELSE 0.0 END AS DOUBLE) AS confidence,
    CASE WHEN tender_no % 3 = 1 AND segment <> 'BUILDING' THEN '' ELSE '12345' END AS hints FROM tenders""")
def _(t: Tables):
    m = F.col("tender_no") % 3
    decision = F.when(m == 0, "SOMETHING").when(m == 1, "DROP_OUT_OF_SCOPE_SUPPLY_SERVICE").otherwise("KEEP_ACTIVE_TENDER")
    confidence = F.when(m == 0, 1.7).when(m == 1, 0.95)
    g = filters.triage_guard(decision, confidence, F.lit(""), F.array(F.lit("12345"), F.lit("12"), F.lit("12345")), F.col("t"), F.col("deadline"), F.col("budget"))
    return t.sql(_ROADISH).select("tender_no", g.alias("g")).select("tender_no", "g.decision", "g.confidence", F.array_join("g.hints", ",").alias("hints"))


@query("c22_pricing_document_predicates", cte("lines") + """
  SELECT project, row_number, line_id, document_no % 5 <> 4 AS candidate, document_no % 5 IN (0, 2) AS preserve, CASE document_no % 5 WHEN 0 THEN 80 ELSE 0 END AS priority FROM lines""")
def _(t: Tables):
    n = F.col("source_document")
    return t.lines.select("project", "row_number", "line_id", filters.pricing_candidate(n).alias("candidate"), filters.preserve_document(n, F.lit("")).alias("preserve"), filters.budget_priority(n, F.lit("")).alias("priority"))


@query("c23_budget_text_predicates", cte("tenders") + "SELECT tender_no, tender_no % 3 <> 2 AS has_budget, tender_no % 3 = 1 AS partial FROM tenders")
def _(t: Tables):
    raw = t.sql("""SELECT tender_no, CASE tender_no % 3 WHEN 0 THEN 'Προϋπολογισμός Μελέτης\n1 α\n2 β' WHEN 1 THEN 'Προϋπολογισμός: τιμή μονάδας, ποσότητα, δαπάνη\n 4 α\n 5 β' ELSE '3 χωρίς\n4 πίνακα' END || '\n' || title AS body FROM {tenders}""")
    return raw.select("tender_no", filters.contains_budget(F.col("body")).alias("has_budget"), filters.partial_budget(F.col("body")).alias("partial"))


@query("c24_document_url_filter", "SELECT page_id, page_id % 3 = 0 AS is_document FROM pages")
def _(t: Tables):
    url = F.concat(F.split("url", "[?#]")[0], F.when(F.col("page_id") % 3 == 0, "/a.PDF?x=1").when(F.col("page_id") % 3 == 1, "/a.pdf/view").otherwise("/b?file=c.zip"))
    return t.pages.select("page_id", filters.is_document_url(url).alias("is_document"))


@query("c25_row_key_decorate", cte("tenders") + """
  SELECT tender_no, row_key, CASE WHEN official THEN 'Επίσημο ΕΣΗΔΗΣ' WHEN linked_id IS NOT NULL THEN 'Σύνδεση με ΕΣΗΔΗΣ' ELSE 'Δεν βρέθηκε ακόμα ΕΣΗΔΗΣ' END AS label, deadline AS deadline_display, deadline_iso AS deadline_sort,
    CASE WHEN official THEN 'https://pwgopendata.eprocurement.gov.gr/actSearchErgwn/resources/search/' || registry_id END AS registry_url FROM tenders""")
def _(t: Tables):
    rows = t.tenders.withColumn("linked_ids", F.array_compact(F.array("linked_id"))).withColumn("row_key", filters.row_key(F.col("source"), F.col("official_id"), F.lit(False)))
    out = filters.decorate(rows)
    return out.select("tender_no", "row_key", F.col("official_status_label").alias("label"), "deadline_display", "deadline_sort", "registry_url")


@query("c25_registry_numeric_id", cte("tenders") + r"SELECT tender_no, tender_no % 4 IN (0, 1) AND regexp_full_match(CAST(100000 + tender_no AS VARCHAR), '[0-9]{6}') AS is_registry FROM tenders")
def _(t: Tables):
    raw = t.sql("""SELECT tender_no, CAST(100000 + tender_no AS STRING) AS id, CASE tender_no % 4 WHEN 0 THEN 'ESHIDIS' ELSE 'WEB' END AS kind,
      CASE tender_no % 4 WHEN 1 THEN 'στο Ε.Σ.Η.ΔΗ.Σ ' WHEN 2 THEN 'https://ted.europa.eu/ ' ELSE '' END || title AS body FROM {tenders}""")
    return raw.select("tender_no", filters.registry_numeric_id(F.col("id"), F.col("kind"), F.col("body")).alias("is_registry"))


@query("c26_source_page_flags", """SELECT page_id, contains(lower(html), '__next_data__') OR contains(lower(html), 'captcha') OR page_id % 4 = 0 AS requires_browser, page_id % 4 = 0 AS loopback, page_id % 4 = 1 AS session_hint FROM pages""")
def _(t: Tables):
    body = F.concat("html", F.when(F.col("page_id") % 4 == 0, "AdfLoopbackUtils.runLoopback()").when(F.col("page_id") % 4 == 1, ";jsessionid=1").otherwise(""))
    f = filters.page_flags(body)
    return t.pages.select("page_id", f["requires_browser"].alias("requires_browser"), f["loopback"].alias("loopback"), f["session_hint"].alias("session_hint"))


@query("c27_document_evidence_check", _DOC + f"""
  SELECT doc_id, CASE WHEN contains(f, lower(lang) || ' ') OR ({_TOK('theron')} AND doc_id % 2 = 0) OR (contains(f, 'that the') AND doc_id % 2 = 1) THEN 'DOCUMENT_EVIDENCE_FOUND' ELSE 'DOCUMENT_TEXT_EXTRACTED_NO_SCOPE_AUTHORITY_MATCH' END AS status,
    concat_ws(',', CASE WHEN {_TOK('theron')} AND doc_id % 2 = 0 THEN 'ward-a1' END, CASE WHEN contains(f, 'that the') AND doc_id % 2 = 1 THEN 'ward-b2' END) AS scopes FROM d WHERE f <> ''""".replace("contains(f, lower(lang) || ' ')", "contains(f, lang)"))
def _(t: Tables):
    scopes = [Scope("ward-a1", ("theron",)), Scope("ward-b2", ("that the",))]
    row_scopes = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("ward-a1"))).otherwise(F.array(F.lit("ward-b2")))
    docs = t.documents.select("doc_id", "text", F.upper("lang").alias("authority"), row_scopes.alias("rs"))
    e = filters.document_evidence(F.col("text"), F.col("authority"), scopes, F.col("rs"))
    return docs.select("doc_id", e["status"].alias("status"), F.array_join(e["scopes"], ",").alias("scopes"))


@query("c29_preview_kind", cte("lines") + """
  SELECT project, row_number, line_id, CASE WHEN flag = 'A' THEN 'declaration' WHEN document_no % 5 = 0 THEN 'budget' WHEN document_no % 5 = 3 THEN 'price_list' ELSE 'other' END AS kind,
    CASE WHEN flag = 'A' THEN 'Διακήρυξη' WHEN document_no % 5 = 0 THEN 'Προϋπολογισμός' WHEN document_no % 5 = 3 THEN 'Τιμολόγιο' ELSE 'Λοιπό αρχείο' END AS label FROM lines""")
def _(t: Tables):
    kind = filters.preview_kind(F.when(F.col("flag") == "A", "tender_declaration"), F.col("source_document"))
    return t.lines.select("project", "row_number", "line_id", kind.alias("kind"), filters.preview_label(kind).alias("label"))


@query("c30_reason_pick", cte("tenders") + "SELECT tender_no, CASE WHEN official THEN 'closes ' || deadline ELSE place END AS reason FROM tenders")
def _(t: Tables):
    pair = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"))
    reasons = F.array(pair("Πηγή", F.col("source")), pair("Προθεσμία", F.when(F.col("official"), F.concat(F.lit("closes "), "deadline")).otherwise(" ")), pair("Έγγραφα", F.lit("3")))
    return t.tenders.select("tender_no", filters.reason_pick(reasons, F.col("place")).alias("reason"))


@query("c31_triage_features", _DOC + f"""
  SELECT doc_id, contains(f, 'eshidis') OR doc_id % 2 = 0 AS has_registry_id, regexp_matches(f, '\\b[0-9]{{2}}proc[0-9]{{9}}\\b') AS has_notice_id, doc_id % 3 = 0 OR contains(f, '.pdf') OR contains(f, '.zip') AS has_documents,
    {sql_hits('f', _W)} AS works_terms, substr(text, 1, 1200) AS text_sample FROM d""")
def _(t: Tables):
    official = F.when(F.col("doc_id") % 2 == 0, F.lit("123456"))
    f = filters.triage_features(F.col("text"), official, F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0), works=_W, admin=_A, supply=_SUP)
    d = t.documents.select("doc_id", f.alias("f"))
    return d.select("doc_id", "f.has_registry_id", "f.has_notice_id", "f.has_documents", F.array_join("f.works_terms", ",").alias("works_terms"), "f.text_sample")


def _label_sql(c: dict) -> str:
    n = lambda terms: "(" + (" + ".join(f"CAST(contains(f, '{x}') AS INTEGER)" for x in terms) or "0") + ")"
    cpv = "(" + (" + ".join(f"CAST(contains(cpv, '{x}') AS INTEGER)" for x in c["cpv"]) or "0") + ")"
    return f"SELECT doc_id, '{c['id']}' AS id, '{c['label']}' AS label, '{c['polarity']}' AS polarity, 2 * {cpv} + 2 * {n(c['strong'])} + {n(c['medium'])} AS score, CAST({max(3.0, c['weight'] * 2.0)} AS DOUBLE) AS base FROM d"


_LABELS = f"WITH d AS (SELECT doc_id, {sql_fold('text')} AS f, CASE doc_id % 4 WHEN 0 THEN '45233141-9' WHEN 1 THEN '33000000' ELSE '' END AS cpv FROM documents), s AS (" + " UNION ALL ".join(_label_sql(c) for c in TAX) + \
    "), x AS (SELECT *, round(least(0.99::DOUBLE, score / base), 2) AS confidence FROM s WHERE score > 0)"


def _labels(t: Tables):
    cpv = F.when(F.col("doc_id") % 4 == 0, "45233141-9").when(F.col("doc_id") % 4 == 1, "33000000").otherwise("")
    return t.documents.select("doc_id", filters.taxonomy_labels(F.col("text"), cpv, TAX).alias("labels"))


@query("e21_taxonomy_labels", _LABELS + " SELECT doc_id, id, polarity, confidence FROM x")
def _(t: Tables):
    return _labels(t).select("doc_id", F.explode("labels").alias("l")).select("doc_id", "l.id", "l.polarity", "l.confidence")


@query("e22_taxonomy_audit", _LABELS + """, g AS (SELECT d.doc_id, count(x.id) AS n, arg_min(x.id, (CASE x.polarity WHEN 'positive' THEN 0 ELSE 1 END, -x.confidence, x.label)) AS first_id, coalesce(max(x.confidence), 0.0::DOUBLE) AS top,
    count(*) FILTER (x.polarity = 'positive') AS pos, count(*) FILTER (x.polarity = 'negative') AS neg FROM d LEFT JOIN x ON x.doc_id = d.doc_id GROUP BY d.doc_id)
  SELECT doc_id, first_id AS "primary", CAST(n AS INTEGER) AS label_count, top AS top_confidence, pos = 0 OR top < 0.85 OR neg > 0 AS needs_review,
    CASE WHEN n = 0 THEN 'UNKNOWN_REVIEW' WHEN pos = 0 OR top < 0.85 OR neg > 0 THEN 'NEEDS_REVIEW' ELSE 'STRONG' END AS band FROM g""")
def _(t: Tables):
    a = _labels(t).select("doc_id", filters.taxonomy_audit(F.col("labels")).alias("a"))
    return a.select("doc_id", "a.primary", "a.label_count", "a.top_confidence", "a.needs_review", "a.band")



