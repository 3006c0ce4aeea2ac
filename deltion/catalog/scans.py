"""Queries for sources (A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltion import rules
from deltion.catalog.base import Tables, cte, query, sql_any, sql_clean, sql_fold
from deltion.functions.text import haystack
from deltion.operators import monitor
from deltion.session import new_path
from deltion.sources import pages, reports

L = "long"

# A report per tender: its own candidate and one without an id.
_REPORTS = """
  SELECT tender_no, to_json(named_struct('candidates', array(
      named_struct('eshidis_id', official_id, 'title', title, 'authority_name', authority, 'published_at', '', 'submission_deadline', deadline, 'status', CASE WHEN official THEN 'OPEN' END,
        'budget', CASE WHEN official THEN CAST(budget AS STRING) END, 'row_text', 'προϋπ. 1.250,00 ευρώ'),
      named_struct('eshidis_id', '', 'title', 'x', 'authority_name', 'y', 'published_at', '', 'submission_deadline', '', 'status', CAST(NULL AS STRING), 'budget', CAST(NULL AS STRING), 'row_text', '')))) AS payload
  FROM {tenders}"""


@query("a1_scan_candidate_report", cte("tenders") + """
  SELECT tender_no, 0 AS position, 'ESHIDIS' AS source, official_id, title, authority, CASE WHEN official THEN CAST(budget AS VARCHAR) ELSE '1.250,00' END AS budget, CAST(NULL AS VARCHAR) AS published_at,
    deadline AS submission_deadline, CASE WHEN official THEN 'OPEN' ELSE 'DISCOVERED_ACTIVE_CANDIDATE' END AS status FROM tenders""")
def _(t: Tables):
    rows = reports.candidates_from_json(t.sql(_REPORTS), "payload", ["tender_no"])
    return rows.select("tender_no", "position", "source", "official_id", "title", "authority", "budget", "published_at", "submission_deadline", "status")


# A page has the notices of 500 numbers, however many there are.
_CONTENT = """
  SELECT source_id, page, CASE WHEN page % 50 = 0 THEN 'timeout' END AS error,
    CASE WHEN page % 50 = 0 THEN NULL ELSE collect_list(to_json(named_struct('referenceNumber', CASE WHEN order_status = 'P' AND tender_no % 7 = 0 THEN '' ELSE official_id END, 'title', title,
      'organization', named_struct('value', authority), 'finalSubmissionDate', CASE WHEN tender_no % 11 = 0 THEN 'soon' ELSE deadline_iso || 'T12:00:00' END, 'totalCostWithVAT', CAST(budget AS STRING), 'cancelled', tender_no % 13 = 0))) END AS items
  FROM (SELECT *, CASE order_status WHEN 'F' THEN 'khmdhs_notice' WHEN 'O' THEN 'khmdhs_auction' ELSE 'khmdhs_contract' END AS source_id, CAST(tender_no DIV 500 AS INT) AS page FROM {tenders}) x GROUP BY source_id, page"""


def _notice_pages(t: Tables):
    from deltion.schemas import NOTICE

    return t.sql(_CONTENT).select("source_id", "page", "error", F.transform("items", lambda x: F.from_json(x, NOTICE)).alias("content"))


_NOTICE_SRC = cte("tenders") + """, n AS (SELECT *, CASE order_status WHEN 'F' THEN 'khmdhs_notice' WHEN 'O' THEN 'khmdhs_auction' ELSE 'khmdhs_contract' END AS source_id,
    CASE order_status WHEN 'F' THEN 'PROC' WHEN 'O' THEN 'AWRD' ELSE 'SYMV' END AS kind, CAST(tender_no // 500 AS INTEGER) AS page FROM tenders)"""


@query("a2_scan_notice_pages", _NOTICE_SRC + """
  SELECT official_id, kind AS record_type, title, authority, CAST(budget AS VARCHAR) AS budget,
    CASE WHEN kind = 'AWRD' THEN 'HISTORICAL_AWARD_RECORD' WHEN kind = 'SYMV' THEN 'HISTORICAL_CONTRACT_RECORD' WHEN tender_no % 13 = 0 THEN 'CANCELLED_NOTICE'
      WHEN tender_no % 11 = 0 THEN 'UNKNOWN_DEADLINE_CANDIDATE' WHEN deadline_iso > '1998-06-15' THEN 'SUBMISSION_OPEN_CANDIDATE' ELSE 'SUBMISSION_EXPIRED_CANDIDATE' END AS status,
    'https://cerpp.eprocurement.gov.gr/khmdhs-opendata/' || CASE kind WHEN 'PROC' THEN 'notice' WHEN 'AWRD' THEN 'auction' ELSE 'contract' END || '/attachment/' || official_id AS attachment_url
  FROM n WHERE page % 50 <> 0 AND NOT (order_status = 'P' AND tender_no % 7 = 0)""")
def _(t: Tables):
    rows = reports.notice_rows(_notice_pages(t), F.to_date(F.lit("1998-06-15")))
    return rows.select("official_id", "record_type", "title", "authority", "budget", "status", "attachment_url")


@query("a2_page_stats", _NOTICE_SRC + """
  SELECT source_id, page, CASE WHEN page % 50 = 0 THEN NULL ELSE CAST(count(*) AS INTEGER) END AS items_returned,
    CASE WHEN page % 50 = 0 THEN 'timeout' END AS error FROM n GROUP BY source_id, page""")
def _(t: Tables):
    return reports.page_stats(_notice_pages(t))


@query("a3_scan_feed_items", cte("tenders") + """
  SELECT tender_no, adapter, title, CASE adapter WHEN 'decisions' THEN CASE WHEN m = 0 THEN '24PROC' || lpad(official_id, 9, '0') ELSE 'AUTH-' || substr(sha256('ADA' || official_id), 1, 16) END
      WHEN 'posts' THEN 'AUTH-' || substr(sha256('https://city.example/p/' || official_id), 1, 16) ELSE 'AUTH-' || substr(sha256('EU' || official_id), 1, 16) END AS official_id,
    CASE WHEN adapter = 'decisions' AND m = 0 THEN 'PROC' ELSE 'AUTHORITY_WEB' END AS record_type, deadline_iso AS published_at,
    CASE adapter WHEN 'posts' THEN 'https://city.example/f/' || official_id || '.pdf' WHEN 'decisions' THEN 'https://acts.example/' || official_id || '.pdf' ELSE 'https://eu.example/' || official_id || '.pdf' END AS attachment_url,
    1 AS attachments FROM (SELECT *, tender_no % 2 AS m, CASE source WHEN 'ESHIDIS' THEN 'decisions' WHEN 'KIMDIS' THEN 'posts' ELSE 'eu_notices' END AS adapter FROM tenders)""")
def _(t: Tables):
    src = t.sql("""
      SELECT tender_no, 'https://city.example/' AS page_url, source,
        CASE source WHEN 'KIMDIS' THEN to_json(array(named_struct('id', official_id, 'link', 'https://city.example/p/' || official_id, 'date', deadline_iso, 'title', named_struct('rendered', '<b>' || title || '</b>'),
            'content', named_struct('rendered', '<p>see <a href="https://city.example/f/' || official_id || '.pdf">file</a></p>'), 'excerpt', named_struct('rendered', ''))))
        WHEN 'ESHIDIS' THEN to_json(named_struct('decisions', array(named_struct('ada', 'ADA' || official_id, 'subject', title, 'documentUrl', 'https://acts.example/' || official_id || '.pdf', 'issueDate', deadline_iso,
            'protocolNumber', CASE WHEN tender_no % 2 = 0 THEN '24PROC' || lpad(official_id, 9, '0') END))))
        ELSE to_json(named_struct('notices', array(named_struct('publication-number', 'EU' || official_id, 'publication-date', deadline_iso, 'notice-title', map('fra', 'titre', 'eng', title),
            'links', named_struct('html', map('eng', 'https://eu.example/' || official_id), 'pdf', map('eng', 'https://eu.example/' || official_id || '.pdf')))))) END AS payload
      FROM {tenders}""")
    out = None
    for source, adapter in (("ESHIDIS", "decisions"), ("KIMDIS", "posts"), ("AUTHORITY", "eu_notices")):
        part = reports.scan_feed_items(src.filter(F.col("source") == source), "payload", adapter, "page_url", ["tender_no"]).withColumn("adapter", F.lit(adapter))
        out = part if out is None else out.unionByName(part)
    return out.select("tender_no", "adapter", "title", "official_id", "record_type", "published_at", "attachment_url", "attachments")


_LI = """WITH r AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS item, generate_subscripts(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), 1) - 1 AS position FROM pages),
  a AS (SELECT *, regexp_extract(item, 'href="([^"]+)"', 1) AS href, """ + sql_clean("regexp_replace(item, '<[^>]+>', ' ', 'g')") + """ AS label FROM r)"""


@query("a4_table_listing", _LI + """
  SELECT page_id, CAST(position AS INTEGER) AS position, nullif(label, '') AS title, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS detail_url, label AS row_text FROM a""")
def _(t: Tables):
    return pages.table_listing(t.pages, "html", "url", ["page_id"], "li").select("page_id", "position", "title", "detail_url", "row_text")


@query("a4_extract_html_listing", """
  WITH w AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, '<article class="post"><time datetime="2024-01-0' || CAST(page_id % 9 + 1 AS VARCHAR) || '"></time><div class="blog"><a href="/n/' || page_id || '">Notice ' || page_id || '</a></div><a href="f.pdf">file</a></article>' AS listing FROM pages)
  SELECT page_id, 0 AS position, 'Notice ' || page_id AS title, root || '/n/' || page_id AS detail_url, 1 AS documents, '2024-01-0' || CAST(page_id % 9 + 1 AS VARCHAR) AS published_at, 'Notice ' || page_id || ' file' AS row_text FROM w""")
def _(t: Tables):
    listing = """SELECT page_id, url, '<html><nav><a href="/x">menu</a></nav><article class="post"><time datetime="2024-01-0' || CAST(page_id % 9 + 1 AS STRING) || '"></time><div class="blog"><a href="/n/' || page_id || '">Notice '
      || page_id || '</a></div><a href="f.pdf">file</a></article></html>' AS listing FROM {pages}"""
    items = pages.extract_html_listing(t.sql(listing), "listing", "url", ["page_id"])
    return items.select("page_id", "position", "title", "detail_url", F.size("attachment_urls").alias("documents"), "published_at", "row_text")


# The same fold over the tags of a page, from list functions; anchors of these pages are no documents.
_CONTAINERS = """WITH e AS (SELECT page_id, url, html, regexp_extract_all(html, '{m}') AS tags, string_split_regex(html, '{m}') AS gaps FROM pages),
  t AS (SELECT page_id, unnest(tags) AS tag, unnest(gaps[:len(tags)]) AS gap, generate_subscripts(tags, 1) AS i FROM e),
  p AS (SELECT page_id, i, tag, lower(regexp_extract(tag, '(?is)^</?([a-z][a-z0-9-]*)', 1)) AS name, 1 + sum(length(gap)) OVER w + coalesce(sum(length(tag)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM t WINDOW w AS (PARTITION BY page_id ORDER BY i)),
  v AS (SELECT *, starts_with(tag, '</') AS ends, NOT starts_with(tag, '</') AND (name IN ('article', 'li') OR (regexp_matches(tag, '(?is)class\\s*=\\s*["''][^"'']*(views-row|post|article|blog)') AND name <> '' AND name NOT IN ('br', 'img', 'input', 'meta', 'link', 'hr'))) AS opens FROM p),
  f AS (SELECT page_id, list_reduce(list_prepend({{'name': '', 'opens': false, 'first': 0::BIGINT, 'last': 0::BIGINT, 'open': []::VARCHAR[], 'spans': []::STRUCT(a BIGINT, z BIGINT)[]}},
      list({{'name': name, 'opens': opens, 'first': first::BIGINT, 'last': (first + length(tag) - 1)::BIGINT, 'open': []::VARCHAR[], 'spans': []::STRUCT(a BIGINT, z BIGINT)[]}} ORDER BY i)),
    lambda s, x: {{'name': '', 'opens': false, 'first': CASE WHEN x.opens AND len(s.open) = 0 THEN x.first ELSE s.first END, 'last': 0::BIGINT,
      'open': CASE WHEN x.opens THEN list_append(s.open, x.name) WHEN len(s.open) > 0 AND s.open[-1] = x.name THEN s.open[:-2] ELSE s.open END,
      'spans': CASE WHEN NOT x.opens AND len(s.open) = 1 AND s.open[-1] = x.name THEN list_append(s.spans, {{'a': s.first, 'z': x.last}}) ELSE s.spans END}}).spans AS spans FROM v WHERE opens OR ends GROUP BY page_id),
  c AS (SELECT page_id, unnest(spans) AS s, generate_subscripts(spans, 1) - 1 AS position FROM f),
  d AS (SELECT e.page_id, e.url, position, substr(html, s.a, s.z - s.a + 1) AS part FROM c JOIN e USING (page_id)),
  l AS (SELECT *, regexp_extract(part, '(?is)<a\\b[^>]*?href=["'']([^"'']+)["'']', 1) AS href, regexp_extract(part, '(?is)<a\\b[^>]*?href=["''][^"'']+["''][^>]*>(.*?)</a>', 1) AS label FROM d)
  SELECT page_id, CAST(position AS INTEGER) AS position, nullif({label}, '') AS title, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS detail_url FROM l WHERE href <> ''"""


@query("a4_page_containers", _CONTAINERS.format(m=pages.MARKUP, label=sql_clean("replace(regexp_replace(label, '<[^>]+>', ' ', 'g'), '&amp;', '&')")))
def _(t: Tables):
    return pages.extract_html_listing(t.pages, "html", "url", ["page_id"]).select("page_id", "position", "title", "detail_url")


# Tenders printed as a grid, 500 numbers a page, some rows repeated on a later page.
_GRID = """SELECT page, concat('<table><tr><th>Κατάσταση CPV αρχίζει</th></tr>', array_join(array_sort(collect_list(row)), ''), '</table>') AS html FROM (
    SELECT tender_no DIV 500 AS page, '<tr role="row"><td>' || CAST(1000000 + tender_no AS STRING) || '</td><td>' || title || '</td><td><b>' || title || ' &amp; more</b></td><td>ΔΗΜΟΣ ' || place || '</td><td>' || deadline || ' 10:00</td></tr>' AS row FROM {tenders}
    UNION ALL SELECT tender_no DIV 500 + 1000000000, '<tr role="row"><td>' || CAST(1000000 + tender_no AS STRING) || '</td><td>again</td></tr>' FROM {tenders} WHERE official) x GROUP BY page"""


@query("a5_extract_html_table_rows", cte("tenders") + """
  SELECT CAST(1000000 + tender_no AS VARCHAR) AS official_id, title || ' & more' AS title, 'ΔΗΜΟΣ ' || place AS authority, CAST(NULL AS VARCHAR) AS published_at FROM tenders""")
def _(t: Tables):
    rows = pages.extract_html_table_rows(t.sql(_GRID), "html", ["page"], ["page"])
    return rows.select("official_id", "title", "authority", "published_at")


@query("a5_grid_rows", cte("tenders") + """
  SELECT CAST(1000000 + tender_no AS VARCHAR) AS official_id, title, 'ΔΗΜΟΣ ' || place AS authority, deadline || ' 10:00' AS published_at, CAST(NULL AS VARCHAR) AS submission_deadline FROM tenders""")
def _(t: Tables):
    rows = pages.extract_html_table_rows(t.sql(_GRID), "html", ["page"], ["page"], mode="grid")
    return rows.select("official_id", "title", "authority", "published_at", "submission_deadline")


@query("a6_extract_labelled_fields", cte("tenders") + """
  SELECT tender_no, official_id AS eshidis_id, title, authority, CASE WHEN official THEN NULL ELSE place END AS location, CAST(budget AS VARCHAR) AS budget_with_vat, deadline AS submission_deadline FROM tenders""")
def _(t: Tables):
    raw = t.sql("""SELECT tender_no, 'Συνοπτικός Τίτλος/Αρ. Διακήρυξης: ' || title || '\n ΑΑ Συστήματος: ' || official_id || ' Κωδικός CPV: 45233 Πρόσθετη περιγραφή - Αναθέτουσα Αρχή:  ' || authority || ' Τοποθεσίες Έργου: '
      || CASE WHEN official THEN '' ELSE place END || ' Τίτλος Έργου/Μελέτη: έργο Χρηματοδοτήσεις: - Συνολικός Προϋπολογισμός (με ΦΠΑ): ' || CAST(budget AS STRING) || ' Ημερομηνία Δημοσίευσης: 1 Καταληκτική Ημ/νία Υποβολής Προσφορών : '
      || deadline || ' Ποσό Κατακύρωσης: -' AS body FROM {tenders}""")
    return pages.extract_labelled_fields(raw, "body", ["tender_no"]).select("tender_no", "eshidis_id", "title", "authority", "location", "budget_with_vat", "submission_deadline")


@query("a7_extract_attachment_listing", cte("tenders") + """
  SELECT tender_no, 3 AS row_count, 'ΔΙΑΚΗΡΥΞΗ ' || official_id || '.pdf|budget & plan.pdf' AS names FROM tenders""")
def _(t: Tables):
    raw = t.sql("""SELECT tender_no, '<x _rowCount="3"><span id="t1:0:it2::content" class="a">ΔΙΑΚΗΡΥΞΗ  ' || official_id || '.pdf</span><span id="t1:1:it2::content">budget &amp;amp; <b>plan.pdf</b></span><span id="t1:2:it2::content">ΔΙΑΚΗΡΥΞΗ ' || official_id || '.pdf</span>' AS xml FROM {tenders}""")
    return pages.extract_attachment_listing(raw, "xml", ["tender_no"]).select("tender_no", "row_count", F.array_join("filenames", "|").alias("names"))


@query("a7_document_links", _LI + f""", h AS (SELECT page_id, regexp_extract(item, 'href="([^"]+)"', 1) AS href, label, lower(label || ' ' || href) AS low FROM a)
  SELECT page_id, href, label AS text, count(*) AS n FROM h WHERE {sql_any('low', ['der', 'ing', 'para'])} GROUP BY ALL""")
def _(t: Tables):
    found = pages.document_links(t.pages, "html", ["page_id"], words=("der", "ing", "para"))
    return found.groupBy("page_id", "href", "text").agg(F.count(F.lit(1)).alias("n"))


@query("a8_scan_files", """SELECT 'pages.parquet' AS name, count(*) > 0 AS found, 64 AS digest_length FROM pages""")
def _(t: Tables):
    # A table is one file or a folder of them; all its files are read.
    files = reports.scan_files(t.spark, f"{t.folder}/pages.parquet", "*.parquet")
    table = F.regexp_extract("path", r"([^/]+\.parquet)(?:/[^/]+)?$", 1).alias("name")
    return files.groupBy(table).agg((F.min("size_bytes") > 0).alias("found"), F.min(F.length("sha256")).alias("digest_length"))


_RULES = rules.load_evaluation_rules({"rules": [
    {"id": "en_terms", "label": "English wording", "document_types": ["en"], "phrases": ["the of", "and the"], "score": 2.0, "severity": "info"},
    {"id": "de_terms", "document_types": ["de"], "phrases": ["nicht"], "score": 0, "severity": "important"},
    {"label": "French", "document_types": ["fr", "es"], "phrases": ["que"]},
]})


@query("a9_load_rules", """
  WITH r(rule_id, label, lang, score, severity) AS (VALUES ('en_terms', 'English wording', 'en', 2.0, 'info'), ('de_terms', 'de_terms', 'de', 1.0, 'important'), ('rule_3', 'French', 'fr', 1.0, 'info'), ('rule_3', 'French', 'es', 1.0, 'info'))
  SELECT rule_id, label, severity, count(*) AS documents, CAST(sum(score) AS DOUBLE) AS score FROM documents d JOIN r ON d.lang = r.lang GROUP BY ALL""")
def _(t: Tables):
    table = rules.rules_table(t.spark, _RULES, "rule_id string, label string, document_types array<string>, score double, severity string")
    per_type = table.withColumn("lang", F.explode("document_types"))
    counted = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # one row per language
    return counted.join(per_type, "lang").groupBy("rule_id", "label", "severity").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("score")).alias("score"))


@query("a10_validate_rules", """
  SELECT p_partkey, trim(lower(regexp_replace(p_name, '[^a-zA-Z0-9_]+', '_', 'g')), '_') AS rule_id, CASE WHEN p_size % 4 = 0 THEN trim(lower(regexp_replace(p_name, '[^a-zA-Z0-9_]+', '_', 'g')), '_') ELSE p_brand END AS label,
    CASE WHEN p_size % 3 <> 2 THEN CASE p_size % 3 WHEN 0 THEN '>=' ELSE '~' END END AS operator, CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE CAST(p_size % 5 AS DOUBLE) END AS score, p_size % 3 = 1 AS invalid_operator
  FROM part WHERE p_type <> 'PROMO'""")
def _(t: Tables):
    raw = t.sql("""SELECT p_partkey, p_name AS id, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS label, CASE WHEN p_type = 'PROMO' THEN array(' ') ELSE array(p_type) END AS phrases,
      CASE p_size % 3 WHEN 0 THEN '>=' WHEN 1 THEN '~' ELSE '' END AS operator, CAST(5 AS DOUBLE) AS threshold, CAST(p_size % 5 AS DOUBLE) AS score, '' AS severity FROM {part}""")
    valid = rules.validate_rules(raw, strict=False, keep=["p_partkey"])
    return valid.select("p_partkey", "rule_id", "label", "operator", "score", "invalid_operator")


@query("a11_listing_token", f"""
  WITH a AS (SELECT page_id, html, list_zip(regexp_extract_all(html, '(?s)<a href="([^"]+)">(.*?)</a>', 1), regexp_extract_all(html, '(?s)<a href="([^"]+)">(.*?)</a>', 2)) AS links FROM pages),
  f AS (SELECT page_id, html, [x for x in [z[1] || chr(9) || substr({sql_clean("z[2]")}, 1, 160) for z in links] if regexp_matches(x, '(der|keit|anza)')] AS lines FROM a)
  SELECT page_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(list_slice(lines, 1, 8), chr(10)))
    ELSE sha256(substr(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '\\s+', ' ', 'g'), 1, 20000)) END AS token FROM f""")
def _(t: Tables):
    return t.pages.select("page_id", pages.listing_token(F.col("html"), wanted="(der|keit|anza)").alias("token"))


@query("a12_scan_state", cte("runs") + "SELECT run_no, source_id, status, json_extract_string(props, '$.k') AS k FROM runs WHERE family IN ('error', 'view') AND status = 'ERROR'")
def _(t: Tables):
    rows = reports.scan_state(t.runs, {"family": ["error", "view"], "status": "ERROR"}, [F.col("source_id"), F.col("run_no").desc()], "props")
    return rows.select("run_no", "source_id", "status", F.col("props")["k"].alias("k"))


_PRINT = cte("runs") + """, f AS (SELECT source_id, arg_min(CAST(run_no AS VARCHAR), -run_no) AS token, arg_min(day, -run_no) AS date, count(*) AS count_hint FROM runs GROUP BY source_id),
  g AS (SELECT *, sha256(source_id || '|' || token || '|' || date || '|' || count_hint) AS fingerprint FROM f)"""


def _fingerprints(t: Tables):
    runs = t.runs.withColumn("position", -F.col("run_no")).withColumn("token", F.col("run_no").cast("string"))
    return monitor.source_fingerprint(runs, "source_id", "position", "token", "day")


@query("a13_source_fingerprint", _PRINT + "SELECT source_id, token, date, count_hint, fingerprint FROM g")
def _(t: Tables):
    return _fingerprints(t)


@query("a13_global_fingerprint", _PRINT + """SELECT concat_ws('-', sum(CAST('0x' || substr(fingerprint, 1, 16) AS UBIGINT))::VARCHAR, sum(CAST('0x' || substr(fingerprint, 17, 16) AS UBIGINT))::VARCHAR, sum(CAST('0x' || substr(fingerprint, 33, 16) AS UBIGINT))::VARCHAR, sum(CAST('0x' || substr(fingerprint, 49, 16) AS UBIGINT))::VARCHAR) AS hash, count(*) AS configured_total,
  count(*) FILTER (s <> 'REQUIRES_IDENTIFIER') AS attempted_total, count(*) FILTER (s = 'REACHED') AS reached_total, count(*) FILTER (s = 'REQUIRES_IDENTIFIER') AS template_total, count(*) FILTER (s = 'ERROR') AS error_total
  FROM (SELECT *, CASE count_hint % 3 WHEN 0 THEN 'REACHED' WHEN 1 THEN 'ERROR' ELSE 'REQUIRES_IDENTIFIER' END AS s FROM g)""")
def _(t: Tables):
    state = F.when(F.col("count_hint") % 3 == 0, "REACHED").when(F.col("count_hint") % 3 == 1, "ERROR").otherwise("REQUIRES_IDENTIFIER")
    return monitor.global_fingerprint(_fingerprints(t).withColumn("state", state), "state")


@query("b17_write_report", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t: Tables):
    path = new_path(t.spark, "report")
    reports.write_report(t.documents.select("doc_id", "lang", "source", "n_chars"), path)
    return t.spark.read.schema("doc_id long, lang string, source string, n_chars long").json(path)


@query("c1_haystack", f"""SELECT doc_id, {sql_fold("source || ' ' || lang || ' ' || text")} AS haystack FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", haystack(F.col("source"), F.col("lang"), F.lit(None), F.col("text")).alias("haystack")).withColumn(
        "haystack", F.regexp_replace("haystack", " +", " "))

