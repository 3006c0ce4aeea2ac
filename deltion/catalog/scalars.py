"""Queries for the scalar functions (I*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltion.catalog.base import Tables, cte, plain, query, sql_any, sql_chars, sql_clean, sql_fold
from deltion.functions import codes, dates, extract, numbers, text

S, D, L = "string", "double", "long"


@query("i1_norm_text", f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.norm_text(F.col("text")).alias("folded"))


@query("i2_strip_accents", "SELECT doc_id, strip_accents(text) AS stripped, upper(strip_accents(replace(text, 'ß', ''))) AS upper FROM documents")
def _(t: Tables):
    c = F.col("text")
    return t.documents.select("doc_id", text.strip_accents(c).alias("stripped"), text.upper_plain(F.replace(c, F.lit("ß"), F.lit(""))).alias("upper"))


# Prices written in four local styles, from the tenders' budgets.
WRITTEN = """
  SELECT tender_no, budget, style, CASE style
      WHEN 0 THEN grouped_int || ',' || cents WHEN 1 THEN replace(grouped_int, '.', ',') || '.' || cents
      WHEN 2 THEN int_part || ',' || cents || '*' ELSE grouped_int END AS written
  FROM (SELECT tender_no, budget, style, int_part, substr(digits, length(digits) - 1, 2) AS cents,
      CASE WHEN length(int_part) > 3 THEN substr(int_part, 1, length(int_part) - 3) || '.' || substr(int_part, length(int_part) - 2, 3) ELSE int_part END AS grouped_int
    FROM (SELECT tender_no, budget, tender_no % 4 AS style, CAST(budget AS STRING) AS digits, CAST(CAST(FLOOR(budget) AS BIGINT) AS STRING) AS int_part FROM {tenders}) a) b"""


@query("i3_parse_locale_number", cte("tenders") + """
  SELECT tender_no, CAST(CASE WHEN tender_no % 4 = 3 THEN FLOOR(budget) ELSE budget END AS DOUBLE) AS number FROM tenders""")
def _(t: Tables):
    return t.sql(WRITTEN).select("tender_no", numbers.parse_locale_number(F.col("written")).cast(D).alias("number"))


@query("i4_format_budget", cte("tenders") + f""", written AS ({plain(WRITTEN).replace('tender_no % 4 AS style', '0 AS style')})
  SELECT tender_no, written || ' EUR' AS shown FROM written""")
def _(t: Tables):
    return t.tenders.select("tender_no", numbers.format_budget(F.col("budget")).alias("shown"))


# Article codes in three spellings that mean the same.
SPELLED = """
  SELECT part_no, row_number, line_id, project, CASE line_id % 3 WHEN 0 THEN article_code WHEN 1 THEN ' b - ' || substr(article_code, 3, 20) ELSE 'B–' || substr(article_code, 3, 20) END AS code,
    'Β' || substr(article_code, 3, 20) AS canonical, CASE line_id % 2 WHEN 0 THEN 'Ο∆Ο-' ELSE 'odo – ' END || CAST(part_no AS STRING) AS revision FROM {lines}"""


@query("i5_canonical_code", cte("lines") + """
  SELECT project, row_number, line_id, 'Β' || substr(article_code, 3) AS article, 'ΟΔΟ-' || CAST(part_no AS VARCHAR) AS revision FROM lines""")
def _(t: Tables):
    return t.sql(SPELLED).select(
        "project", "row_number", "line_id", codes.canonical_article_code(F.col("code")).alias("article"), codes.canonical_revision_code(F.col("revision")).alias("revision")
    )


# Last Sunday of a month of 30 or 31 days; summer time ended in September until 1995.
_SUNDAY = "make_date(year(day), {m}, {d}) - CAST(dayofweek(make_date(year(day), {m}, {d})) AS INTEGER)"
_SUMMER = f"day >= {_SUNDAY.format(m=3, d=31)} AND day < CASE WHEN year(day) < 1996 THEN {_SUNDAY.format(m=9, d=30)} ELSE {_SUNDAY.format(m=10, d=31)} END"


@query("i6_parse_deadline", cte("tenders") + f"""
  SELECT tender_no, deadline_iso || CASE WHEN m IN (0, 1) THEN ' 10:30' ELSE '' END AS sort_key, deadline || CASE WHEN m IN (0, 1) THEN ' 10:30' ELSE '' END AS display,
    strftime(day - CASE WHEN {_SUMMER} THEN INTERVAL 3 HOUR ELSE INTERVAL 2 HOUR END
      + CASE WHEN m IN (0, 1) THEN INTERVAL 630 MINUTE ELSE INTERVAL 86399 SECOND END, '%Y-%m-%d %H:%M:%S') AS instant
  FROM (SELECT *, tender_no % 3 AS m, CAST(deadline_iso AS DATE) AS day FROM tenders)""")
def _(t: Tables):
    raw = t.sql("SELECT tender_no, CASE tender_no % 3 WHEN 0 THEN deadline || ' 10:30' WHEN 1 THEN deadline_iso || 'T10:30' ELSE deadline END AS raw FROM {tenders}")
    c = F.col("raw")
    return raw.select(
        "tender_no", dates.sort_key(c).alias("sort_key"), dates.display(c).alias("display"),
        F.date_format(dates.deadline_instant(c), "yyyy-MM-dd HH:mm:ss").alias("instant"),
    )


# Days of the tenders moved into this century.
@query("i7_extract_dates", cte("tenders") + """
  SELECT tender_no, 2 AS n, '20' || substr(deadline_iso, 3) || ' 09:15,20' || substr(deadline_iso, 3) AS dates, '17,' || CAST(17 + 16 + length(' και ') AS VARCHAR) AS positions FROM tenders""")
def _(t: Tables):
    raw = t.sql("""SELECT tender_no, 'δημοσίευση: 1x, ' || substr(deadline, 1, 2) || '/' || substr(deadline, 4, 2) || '/20' || substr(deadline, 9, 2) || ' 09:15 και 20' || substr(deadline_iso, 3, 8) || ' 99/99/2020' AS body
      FROM {tenders}""")
    # The dates of a text are read once for the three columns.
    shown = text.let(dates.extract_dates(F.col("body")), lambda found: F.struct(
        F.size(found).alias("n"), F.array_join(F.transform(found, lambda x: x["deadline_at"]), ",").alias("dates"),
        F.array_join(F.transform(found, lambda x: x["pos"].cast(S)), ",").alias("positions"),
    ))
    return raw.select("tender_no", shown.alias("_shown")).select("tender_no", "_shown.*")


@query("i8_snippet", f"""
  SELECT doc_id, strpos(folded, 'that the') AS pos,
    {sql_clean("substr(flat, CAST(greatest(strpos(folded, 'that the') - 180, 1) AS INTEGER), CAST(strpos(folded, 'that the') + 188 - greatest(strpos(folded, 'that the') - 180, 1) AS INTEGER))")} AS snippet,
    CASE WHEN length(flat) <= 420 THEN flat ELSE rtrim(substr(flat, 1, 420)) || '...' END AS sample
  FROM (SELECT doc_id, flat, {sql_chars('flat')} AS folded FROM (SELECT doc_id, {sql_clean('text')} AS flat FROM documents)) WHERE contains(folded, 'that the')""")
def _(t: Tables):
    flat = t.documents.select("doc_id", text.clean(F.col("text")).alias("flat")).withColumn("folded", text.fold_chars(F.col("flat")))
    pos = F.instr("folded", F.lit("that the"))
    return flat.filter(pos > 0).select(
        "doc_id", pos.cast(L).alias("pos"), text.snippet(F.col("flat"), pos, 180, 188).alias("snippet"), text.short_sample(F.col("flat"), 420, ellipsis=True).alias("sample")
    )


@query("i9_number_near", r"""
  WITH d AS (SELECT doc_id, substr(text, CAST(greatest(strpos(text, 'License'), 1) AS INTEGER)) AS tail FROM documents WHERE regexp_matches(text, '[0-9]')),
  v AS (SELECT doc_id, [x for x in [try_cast(replace(y, ',', '.') AS DOUBLE) for y in regexp_extract_all(tail, '[0-9]+[,.][0-9]+')] if x > 0 AND x < 1000] AS dec,
    [x for x in [try_cast(CASE WHEN contains(y, ',') AND contains(y, '.') THEN replace(replace(y, '.', ''), ',', '.') ELSE replace(y, ',', '.') END AS DOUBLE) for y in regexp_extract_all(tail, '[0-9]+(?:[.,][0-9]+)*')] if x > 0 AND x < 1000] AS num FROM d)
  SELECT doc_id, coalesce(list_min(dec), list_min(num)) AS number FROM v""")
def _(t: Tables):
    docs = t.documents.filter(F.col("text").rlike("[0-9]"))
    return docs.select("doc_id", numbers.number_near(F.col("text"), F.instr("text", F.lit("License"))).alias("number"))


@query("i10_extract_ids", cte("tenders") + """
  SELECT tender_no, CASE WHEN m < 2 AND length(id6) = 6 THEN id6 WHEN m = 2 THEN id5 ELSE '' END AS ids, CASE WHEN m < 2 AND length(id6) BETWEEN 5 AND 7 THEN id6 END AS system_id
  FROM (SELECT tender_no, tender_no % 4 AS m, CAST(100000 + tender_no AS VARCHAR) AS id6, CAST(10000 + tender_no % 10000 AS VARCHAR) AS id5 FROM tenders)""")
def _(t: Tables):
    raw = t.sql("""
      SELECT tender_no, CASE tender_no % 4
        WHEN 0 THEN 'Α/Α Συστήματος ΕΣΗΔΗΣ: ' || id6 || ' βλ. resources/search/' || CAST(900000 + tender_no AS STRING)
        WHEN 1 THEN 'https://pwgopendata.eprocurement.gov.gr/actSearchErgwn/resources/search/' || id6
        WHEN 2 THEN 'Ε.Σ.Η.ΔΗ.Σ. ' || id5 || ' τέλος' ELSE 'αριθμός μηχανήματος ' || substr(id6, 1, 4) END AS body
      FROM (SELECT tender_no, CAST(100000 + tender_no AS STRING) AS id6, CAST(10000 + tender_no % 10000 AS STRING) AS id5 FROM {tenders}) x""")
    six = F.when(F.col("tender_no") % 4 < 2, extract.first_system_id(F.col("body")))
    return raw.select("tender_no", F.array_join(extract.official_ids(F.col("body")), ",").alias("ids"), six.alias("system_id"))


@query("i11_extract_budget_region", cte("tenders") + f""", written AS ({plain(WRITTEN).replace('tender_no % 4 AS style', '0 AS style')})
  SELECT w.tender_no, CAST(w.budget AS DOUBLE) AS last_before_date, '1.000,00' AS first_amount, 'EL6' || CAST(30 + t.customer_no % 6 AS VARCHAR) || ' - ' || t.place AS region
  FROM written w JOIN tenders t ON t.tender_no = w.tender_no""")
def _(t: Tables):
    raw = t.sql("SELECT w.tender_no, 'εγγύηση 1.000,00 σύνολο ' || w.written || ' ' || t.deadline || ' και 5,00 EL6' || CAST(30 + t.customer_no % 6 AS STRING) || '  - ' || t.place || ' ΥΠΟΒΟΛΗ ΠΡΟΣΦΟΡΑΣ' AS body FROM {w} w JOIN {tenders} t ON t.tender_no = w.tender_no", w=t.sql(WRITTEN.replace("tender_no % 4 AS style", "0 AS style")))
    c = F.col("body")
    return raw.select("tender_no", numbers.budget_from_row_text(c).cast(D).alias("last_before_date"), numbers.first_amount(c).alias("first_amount"), extract.region(c).alias("region"))


_TOK = "list_distinct(regexp_extract_all({f}, '[a-zα-ω0-9]{{4,}}'))"


@query("i12_tokens_overlap", f"""
  WITH d AS (SELECT doc_id, lang, {_TOK.format(f=sql_fold("substr(text, 1, length(text) // 2)"))} AS tok, {_TOK.format(f=sql_fold("substr(text, length(text) // 2 + 1)"))} AS tok2 FROM documents)
  SELECT doc_id, array_to_string(list_sort(tok), ' ') AS tokens,
    CASE WHEN least(len(tok), len(tok2)) > 0 THEN round(len(list_intersect(tok, tok2)) / least(len(tok), len(tok2)), 6) ELSE 0.0 END AS overlap FROM d""")
def _(t: Tables):
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    docs = t.documents.select("doc_id", text.title_tokens(first).alias("tok"), text.title_tokens(second).alias("tok2"))
    return docs.select("doc_id", F.array_join("tok", " ").alias("tokens"), F.round(text.token_overlap(F.col("tok"), F.col("tok2")), 6).alias("overlap"))


@query("i13_signature", cte("tenders") + r"""
  SELECT tender_no, sha256(concat_ws(chr(10), row_key, official_id, coalesce(registry_id, ''), title, authority, deadline, CAST(budget AS VARCHAR))) AS signature,
    sha256('{"authority":"' || authority || '"' || CASE WHEN linked_id IS NULL THEN '' ELSE ',"linked_id":"' || linked_id || '"' END || ',"title":"' || title || '"}') AS json_signature,
    'AUTH-' || substr(sha256(official_id), 1, 16) AS hashed_id FROM tenders""")
def _(t: Tables):
    parts = [F.col(c) for c in ("row_key", "official_id", "registry_id", "title", "authority", "deadline", "budget")]
    js = codes.json_signature(title=F.col("title"), authority=F.col("authority"), linked_id=F.col("linked_id"))
    return t.tenders.select("tender_no", codes.signature(*parts).alias("signature"), js.alias("json_signature"), codes.hashed_id(F.col("official_id")).alias("hashed_id"))


@query("i14_json_pick", """SELECT event_id, json_extract_string(props, '$.k') AS picked FROM events""")
def _(t: Tables):
    return t.events.select("event_id", codes.json_pick(F.col("props"), "$.budget", "$.totalCost.value", "$.k").alias("picked"))


_ENT = "html"
for _a, _b in text.ENTITIES.items():
    _q = _b.replace("'", "''")
    _ENT = f"replace({_ENT}, '&{_a};', '{_q}')"
_ENT = f"replace({_ENT}, '&amp;', '&')"


@query("i15_html_text", f"""SELECT page_id, {sql_clean(f"regexp_replace({_ENT}, '<[^>]+>', ' ', 'g')")} AS body,
  {sql_clean(f"regexp_replace(regexp_replace({_ENT}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')")} AS visible FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", text.html_text(F.col("html")).alias("body"), text.html_text(F.col("html"), scripts=True).alias("visible"))


@query("i16_safe_name_urls", r"""
  SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS name,
    url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'org=' || CAST(page_id % 50 AS VARCHAR) || '&q=' || 'a%26b+' || CAST(page_id AS VARCHAR) AS with_params FROM pages""")
def _(t: Tables):
    q = F.concat(F.lit("a&b "), F.col("page_id").cast(S))
    return t.pages.select("page_id", text.safe_name(F.col("url")).alias("name"), text.url_with_params(F.col("url"), org=F.col("page_id") % 50, skipped=F.lit(None), q=q).alias("with_params"))


@query("i17_revision_codes", cte("lines") + """
  SELECT project, row_number, line_id, '40%ΟΔΟ-' || CAST(part_no AS VARCHAR) || ',60%ΥΔΡ-' || CAST(part_no + 1 AS VARCHAR) || ',ΟΙΚ-' || CAST(part_no + 2 AS VARCHAR) AS codes, description FROM lines""")
def _(t: Tables):
    raw = t.sql("""SELECT project, row_number, line_id, description || ' 40%Ο∆Ο-' || CAST(part_no AS STRING) || '+ 60% ΥΔΡ ' || CAST(part_no + 1 AS STRING) || ' ΟΙΚ-' || CAST(part_no + 2 AS STRING)
      || ' ΟΔΟ-' || CAST(part_no AS STRING) AS body FROM {lines}""")
    c = F.col("body")
    return raw.select("project", "row_number", "line_id", F.array_join(codes.revision_codes(c), ",").alias("codes"), codes.clean_description(c).alias("description"))


@query("i18_project_title", cte("tenders") + """
  SELECT tender_no, CASE WHEN tender_no % 4 = 3 THEN NULL ELSE title END AS title FROM tenders""")
def _(t: Tables):
    raw = t.sql("""SELECT tender_no, CASE tender_no % 4 WHEN 0 THEN 'Σχετ. ΚΩΔΙΚΟΣ ΕΡΓΟΥ: 2020ΕΠ/12 ' || title || ' ΤΙΤΛΟΣ ΕΡΓΟΥ άλλος'
      WHEN 1 THEN 'ΤΙΤΛΟΣ ΕΡΓΟΥ: ' || title || ' ΥΠΟΕΡΓΟ 3' WHEN 2 THEN 'πληρωμή με τίτλο ' || title || ' συνολικού ποσού 10' ELSE 'ΤΙΤΛΟΣ ΕΡΓΟΥ: GR1601101250000000012300695 ΥΠΟΕΡΓΟ' END AS body FROM {tenders}""")
    return raw.select("tender_no", extract.project_title(F.col("body")).alias("title"))


@query("i19_keyword_list", f"""
  WITH items AS (SELECT doc_id, i, {sql_clean("s")} AS item FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\n,;]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[\\n,;]+'), 1) AS i FROM documents)),
  keyed AS (SELECT *, {sql_fold('item')} AS k FROM items), firsts AS (SELECT doc_id, k, min(i) AS i FROM keyed WHERE k <> '' GROUP BY ALL),
  ranked AS (SELECT f.doc_id, f.i, substr(x.item, 1, 80) AS item, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.i) AS rn FROM firsts f JOIN keyed x ON x.doc_id = f.doc_id AND x.i = f.i)
  SELECT doc_id, count(*) AS n, string_agg(item, '|' ORDER BY i) AS keywords FROM ranked WHERE rn <= 40 GROUP BY doc_id""")
def _(t: Tables):
    # As the one element of an array the list is made once; a test of its size would be pushed down and make it again.
    docs = text.unnest(t.documents, ["doc_id"], F.array(text.keyword_list(F.col("text"))), "k").filter(F.size("k") > 0)
    return docs.select("doc_id", F.size("k").cast(L).alias("n"), F.array_join("k", "|").alias("keywords"))


_GROUPS = [["with", "für"], ["that", "nicht"], ["para", "une"], ["the of"]]
_NEG = ["license", "hein"]
_pos_sql = " + ".join(f"CAST({sql_any('f', [text.fold_term(x) for x in g])} AS INTEGER)" for g in _GROUPS)


@query("i20_deadline_score", f"""SELECT doc_id, {_pos_sql} - CAST({sql_any('f', _NEG)} AS INTEGER) AS score, {sql_any('f', ['theron', 'mentre'])} AS is_extension,
  round(CAST(least(0.98, 0.55 + 0.1 * ({_pos_sql} - CAST({sql_any('f', _NEG)} AS INTEGER))) AS DOUBLE), 4) AS confidence FROM (SELECT doc_id, {sql_fold('text')} AS f FROM documents)""")
def _(t: Tables):
    score = dates.deadline_score(F.col("text"), [[text.fold_term(x) for x in g] for g in _GROUPS], _NEG)
    docs = t.documents.select("doc_id", score.alias("score"), dates.is_extension(F.col("text"), ["theron", "mentre"]).alias("is_extension"))
    return docs.withColumn("confidence", F.round(F.least(F.lit(0.98), F.lit(0.55) + F.col("score") * F.lit(0.1)), 4))


@query("i22_keyword_score", cte("tenders") + """
  SELECT tender_no, CASE tender_no % 4 WHEN 0 THEN 2 + 6 WHEN 1 THEN 4 + 5 WHEN 2 THEN 0 ELSE 2 + 5 END AS score FROM tenders""")
def _(t: Tables):
    raw = t.sql("""SELECT tender_no, title || CASE tender_no % 4 WHEN 0 THEN ' Προϋπολογισμός μελέτη' WHEN 1 THEN ' τιμή μονάδας, ποσότητα και δαπάνη του άρθρο 3' WHEN 2 THEN ' τιμολόγιο' ELSE ' Συνολική δαπάνη εργασιών' END AS body FROM {tenders}""")
    return raw.select("tender_no", extract.keyword_score(text.upper_plain(F.col("body"))).alias("score"))


@query("i23_unit_order_flag", cte("tenders") + "SELECT tender_no, tender_no % 3 = 1 AS price_first FROM tenders")
def _(t: Tables):
    raw = t.sql("""SELECT tender_no, CASE tender_no % 3 WHEN 0 THEN 'Α/Α Ποσότητα  Τιμή μονάδας Δαπάνη ' WHEN 1 THEN 'Α/Α Τιμή Μονάδας   Ποσότητα Δαπάνη ' ELSE 'χωρίς κεφαλίδα ' END || title AS body FROM {tenders}""")
    return raw.select("tender_no", extract.price_before_quantity(F.col("body")).alias("price_first"))


@query("i24_budget_text_hints", f"""
  WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
  h AS (SELECT doc_id, n, substr({sql_clean('line')}, 1, 240) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM l
    WHERE contains(upper(strip_accents(substr({sql_clean('line')}, 1, 240))), 'THAT'))
  SELECT doc_id, CAST(n AS INTEGER) AS line, line AS hint FROM h WHERE rn <= 5""")
def _(t: Tables):
    docs = t.documents.select("doc_id", F.explode(extract.budget_hints(F.col("text"), "THAT")).alias("h"))
    return docs.select("doc_id", F.col("h.line").alias("line"), F.col("h.text").alias("hint"))


@query("i25_identity", cte("tenders") + """
  SELECT tender_no, CASE WHEN official THEN 'ESHIDIS:' || registry_id WHEN m = 0 THEN 'ESHIDIS:' || linked_id WHEN m = 1 THEN 'KIMDIS:' || notice ELSE row_key END AS canonical_key,
    CASE WHEN official THEN 'ΕΣΗΔΗΣ ' || registry_id WHEN m = 0 THEN 'ΕΣΗΔΗΣ ' || linked_id WHEN m = 1 THEN 'ΚΗΜΔΗΣ ' || notice ELSE source || ' ' || official_id END AS canonical_label
  FROM (SELECT *, tender_no % 3 AS m, '24PROC' || lpad(official_id, 9, '0') AS notice FROM tenders)""")
def _(t: Tables):
    raw = t.sql("SELECT *, CASE WHEN tender_no % 3 = 1 THEN '24PROC' || lpad(official_id, 9, '0') ELSE official_id END AS notice FROM {tenders}")
    linked = F.when(F.col("tender_no") % 3 == 0, F.array("linked_id")).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    ident = extract.identity(F.col("registry_id"), none, linked, F.col("notice"), F.col("row_key"), F.col("source"), F.lit(""))
    return raw.select("tender_no", ident["canonical_key"].alias("canonical_key"), ident["canonical_label"].alias("canonical_label"))


@query("i26_payment_title", cte("tenders") + """
  SELECT tender_no, CASE WHEN tender_no % 3 = 0 THEN 'ΕΝΤΟΛΗ ΠΛΗΡΩΜΗΣ ' || official_id || '-' || deadline_iso WHEN tender_no % 3 = 1 THEN title ELSE row_key END AS shown FROM tenders""")
def _(t: Tables):
    m = F.col("tender_no") % 3
    return t.tenders.select("tender_no", extract.payment_title(F.when(m == 0, F.col("official_id")), F.when(m == 0, F.col("deadline_iso")), F.when(m == 1, F.col("title")), F.col("row_key")).alias("shown"))
