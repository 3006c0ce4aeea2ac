"""Queries for ordered operators (F*), sorts and top-k (G*) and set operations (H*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltion.catalog.aggregating import _HEALTH_SQL, _POLL_SQL, health, polling
from deltion.catalog.base import Tables, cte, query, sql_clean, sql_fold
from deltion.functions.dates import parse_local
from deltion.operators import ranking as rk

L, D = "long", "double"


@query("f1_latest_per_key", cte("runs") + " SELECT source_id, family, max(run_no) AS run_no, arg_max(cents, run_no) AS cents FROM runs GROUP BY source_id, family")
def _(t: Tables):
    return rk.latest_per_key(t.runs, ["source_id", "family"], "run_no").select("source_id", "family", "run_no", "cents")


@query("f2_prefer_then_latest", cte("runs") + " SELECT source_id, arg_max(run_no, (CASE WHEN family = 'purchase' THEN 1 ELSE 0 END, run_no)) AS run_no FROM runs GROUP BY source_id")
def _(t: Tables):
    return rk.prefer_then_latest(t.runs, "source_id", F.col("family") == "purchase", "run_no").select("source_id", "run_no")


@query("f4_source_health", cte("runs") + "," + _HEALTH_SQL + " SELECT source_id, c AS recent_checks, f AS recent_failures, k AS consecutive_failures, status FROM health")
def _(t: Tables):
    return health(t).select("source_id", "recent_checks", "recent_failures", "consecutive_failures", "status")


@query("f5_top_evidence", cte("lines") + f""", d AS (SELECT DISTINCT project, source_document AS name, document_no FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY CASE document_no % 5 WHEN 1 THEN 1 ELSE CASE WHEN document_no % 2 = 0 THEN 2 ELSE 3 END END, {sql_fold('name')}, name) AS position FROM d)
  SELECT project, name, CAST(position AS INTEGER) AS position FROM r WHERE position <= 4""")
def _(t: Tables):
    docs = t.lines.select("project", F.col("source_document").alias("name"), "document_no").distinct()
    return rk.top_evidence(docs, "project", "name", rk.document_rank(F.col("name"), F.lit(""), F.col("document_no") % 2 == 0), 4).select("project", "name", "position")


@query("f6_best_deadline", cte("tenders") + """ SELECT customer_no, arg_max(deadline, (deadline_iso, official, CAST(budget AS DOUBLE), deadline)) AS deadline_at, arg_max(official, (deadline_iso, official, CAST(budget AS DOUBLE), deadline)) AS is_extension FROM tenders WHERE place <> 'ASIA' GROUP BY customer_no""")
def _(t: Tables):
    e = t.tenders.select("customer_no", F.when(F.col("place") == "ASIA", "9999").otherwise(F.col("deadline_iso")).alias("deadline_key"), F.col("official").alias("is_extension"), F.col("budget").cast(D).alias("confidence"), F.col("deadline").alias("deadline_at"))
    return rk.best_deadline(e, "customer_no").select("customer_no", "deadline_at", "is_extension")


@query("f7_first_wins", cte("tenders") + " SELECT customer_no, source, min(tender_no) AS tender_no FROM tenders GROUP BY ALL")
def _(t: Tables):
    return rk.first_wins(t.tenders, ["customer_no", "source"], "tender_no").select("customer_no", "source", "tender_no")


@query("f8_last_wins", "SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def _(t: Tables):
    return rk.last_wins(t.conversations, ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


@query("f11_row_index", cte("runs") + " SELECT run_no, family, row_number() OVER (PARTITION BY family ORDER BY run_no) - 1 AS position FROM runs")
def _(t: Tables):
    return rk.position_in_group(t.runs.select("run_no", "family"), "family", F.col("run_no"), F.floor(F.col("run_no") / 1000))


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS idx FROM l WHERE trim(line) <> '')"


@query("f12_line_context", _LINES + """, w AS (SELECT doc_id, idx, rtrim(line) AS line, concat_ws('|', lag(line, 3) OVER o, lag(line, 2) OVER o, lag(line, 1) OVER o) AS before, concat_ws('|', lead(line, 1) OVER o, lead(line, 2) OVER o, lead(line, 3) OVER o) AS after FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY idx))
  SELECT doc_id, CAST(idx AS INTEGER) AS idx, line, before, after FROM w""")
def _(t: Tables):
    from deltion.functions.text import unnest

    rows = unnest(t.documents, ["doc_id"], rk.line_context(F.col("text")), "l")
    return rows.select("doc_id", "l.idx", "l.line", F.array_join("l.before", "|").alias("before"), F.array_join("l.after", "|").alias("after"))


@query("f13_fill_marker", """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(turn * 10 AS VARCHAR) ELSE '~' END AS marker FROM conversations), g AS (SELECT *, count(CASE WHEN marker <> '~' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m),
  n AS (SELECT conv_id, turn, CASE WHEN island = 0 THEN NULL ELSE max(try_cast(marker AS INTEGER)) OVER (PARTITION BY conv_id, island) + row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1 END AS num FROM g)
  SELECT conv_id, turn, CAST(num AS INTEGER) AS number FROM n""")
def _(t: Tables):
    marked = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", (F.col("turn") * 10).cast("string")).otherwise("~").alias("marker"))
    return rk.fill_marker_rows(marked, "conv_id", "turn", "marker", F.floor(F.col("turn") / 4)).select("conv_id", "turn", "number")


@query("f14_latest_success", cte("runs") + " SELECT 'latest' AS which, max(run_no) AS run_no FROM runs UNION ALL SELECT 'success', max(run_no) FROM runs WHERE family = 'purchase'")
def _(t: Tables):
    a = rk.latest_run(t.runs, "run_no").select(F.lit("latest").alias("which"), "run_no")
    return a.unionByName(rk.latest_run(t.runs, "run_no", F.col("family") == "purchase").select(F.lit("success").alias("which"), "run_no"))


@query("f15_text_windows", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
  b AS (SELECT doc_id, n // 4 AS block, {sql_clean("string_agg(line, chr(10) ORDER BY n)")} AS body FROM l GROUP BY ALL),
  s AS (SELECT *, CAST((length(body) - length(replace(body, 'th', ''))) // 2 AS INTEGER) AS score FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, block) AS rn FROM s WHERE score > 0)
  SELECT doc_id, score, CAST(block * 4 + 1 AS INTEGER) AS line_start, substr(body, 1, 900) AS snippet FROM r WHERE rn <= 3""")
def _(t: Tables):
    from deltion.functions.text import unnest

    score = lambda b: F.floor((F.length(b) - F.length(F.replace(b, F.lit("th"), F.lit("")))) / 2).cast("int")
    rows = unnest(t.documents, ["doc_id"], rk.text_windows(F.col("text"), score, size=4), "w")
    return rows.select("doc_id", "w.score", "w.line_start", "w.snippet")


@query("f16_unique_names", cte("runs") + """, r AS (SELECT run_no, source_id, family || '.pdf' AS name, row_number() OVER (PARTITION BY source_id, family ORDER BY run_no) AS n FROM runs) SELECT run_no, source_id, CASE WHEN n = 1 THEN name ELSE replace(name, '.pdf', '') || '_' || n || '.pdf' END AS unique_name FROM r""")
def _(t: Tables):
    files = t.runs.select("run_no", "source_id", F.concat("family", F.lit(".pdf")).alias("name"))
    return rk.unique_names(files, "source_id", "name", "run_no", F.floor(F.col("run_no") / 1000)).select("run_no", "source_id", "unique_name")


@query("f17_prefix_until_exhausted", cte("runs") + """, p AS (SELECT *, run_no // 500 AS page FROM runs), a AS (SELECT source_id, page, bool_and(cents < 1000) AS out FROM p GROUP BY ALL), s AS (SELECT source_id, min(page) FILTER (out) AS stop FROM a GROUP BY source_id)
  SELECT run_no, p.source_id FROM p JOIN s ON s.source_id = p.source_id WHERE stop IS NULL OR page <= stop""")
def _(t: Tables):
    pages = t.runs.withColumn("page", F.floor(F.col("run_no") / 500))
    return rk.prefix_until_exhausted(pages, "source_id", "page", F.col("cents") < 1000).select("run_no", "source_id")


_AT = """SELECT project, row_number, line_id, 'Άρθρο\nA.T.: ' || CAST(row_number AS STRING) || '\nκείμενο\n(Αριθμητικώς): ' || replace(CAST(CAST(amount AS DECIMAL(18,2)) AS STRING), '.', ',') || '\nΑ.Τ. : 99\nχωρίς τιμή' AS body FROM {lines}"""


@query("f18_marker_unit_prices", cte("lines") + " SELECT project, row_number, line_id, CAST(row_number AS INTEGER) AS marker, CAST(amount AS DOUBLE) AS price FROM lines")
def _(t: Tables):
    rows = t.sql(_AT).select("project", "row_number", "line_id", F.explode_outer(rk.marker_unit_prices(F.col("body"))).alias("marker", "price"))
    return rows.withColumn("price", F.col("price").cast(D))


@query("g1_sort_rows", cte("tenders") + " SELECT row_key, CAST(budget AS DOUBLE) AS budget, deadline_iso AS deadline_sort FROM tenders ORDER BY budget DESC, deadline_iso, row_key")
def _(t: Tables):
    rows = t.tenders.select("row_key", F.col("budget").cast(D).alias("budget"), F.col("deadline_iso").alias("deadline_sort"))
    return rk.sort_rows(rows, "budget_desc", key="row_key")


@query("g2_sort_hidden", cte("tenders") + " SELECT row_key, official_id AS display_id, CASE WHEN official THEN deadline_iso END AS audit_at, CASE order_status WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'LOW' ELSE 'MEDIUM' END AS priority FROM tenders")
def _(t: Tables):
    rows = t.tenders.select("row_key", F.col("official_id").alias("display_id"), F.when(F.col("official"), F.col("deadline_iso")).alias("audit_at"), F.when(F.col("order_status") == "F", "HIGH").when(F.col("order_status") == "O", "LOW").otherwise("MEDIUM").alias("priority"))
    return rk.sort_hidden(rows, "audit_at", "priority")


@query("g3_problem_sources", _POLL_SQL + " SELECT source_id, st AS last_status FROM p WHERE er IS NOT NULL OR st = 'ERROR' OR coalesce(hs IN ('WATCH', 'DEGRADED', 'DISABLE_CANDIDATE'), false) ORDER BY CASE WHEN er IS NOT NULL OR st = 'ERROR' THEN 0 ELSE 1 END, source_id LIMIT 12")
def _(t: Tables):
    return rk.problem_sources(polling(t), 12).select("source_id", "last_status")


@query("g4_attention_buckets", cte("tenders") + """ SELECT row_key, 'Λήγουν σύντομα' AS bucket FROM tenders WHERE deadline_iso BETWEEN '1998-07-17' AND '1998-07-24' UNION ALL SELECT row_key, 'Χωρίς έγγραφα' FROM tenders WHERE segment = 'BUILDING' UNION ALL SELECT row_key, 'Χωρίς ΕΣΗΔΗΣ' FROM tenders WHERE NOT official
  UNION ALL SELECT row_key, 'Υψηλότεροι προϋπολογισμοί' FROM (SELECT row_key, row_number() OVER (PARTITION BY place ORDER BY budget DESC, row_key) AS rn FROM tenders) WHERE rn <= 3""")
def _(t: Tables):
    days = F.datediff(F.col("deadline_iso").cast("date"), F.lit("1998-07-17").cast("date"))
    out = rk.attention_buckets(t.tenders, days, F.col("segment") != "BUILDING", F.col("official"), F.col("budget"), "row_key", ["place"], 3)
    return out.select("row_key", "bucket")


@query("g5_nested_topk", cte("runs") + """, h AS (SELECT DISTINCT source_id FROM runs ORDER BY source_id LIMIT 80), r AS (SELECT run_no, source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY cents DESC, run_no) AS INTEGER) AS match_rank FROM runs) SELECT r.source_id, r.run_no, r.match_rank FROM r JOIN h ON h.source_id = r.source_id WHERE match_rank <= 6""")
def _(t: Tables):
    return rk.nested_topk(t.runs, "source_id", ["source_id"], [F.col("cents").desc(), F.col("run_no")], 80, 6).select("source_id", "run_no", "match_rank")


@query("g7_order_candidates", cte("tenders") + " SELECT customer_no, min(tender_no) AS tender_no FROM tenders GROUP BY customer_no")
def _(t: Tables):
    return rk.order_candidates(t.tenders, "customer_no", parse_local(F.col("deadline")), "tender_no").select("customer_no", "tender_no")


@query("g8_two_stage_topk", cte("lines") + """, d AS (SELECT project, source_document AS name, count(*) AS light, CAST(sum(row_number) AS BIGINT) AS full_score, max(document_no) % 5 AS m FROM lines GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY light DESC, name) AS rn FROM d),
  f AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY CASE WHEN m = 0 THEN 80 ELSE 0 END DESC, full_score DESC, name) AS INTEGER) AS position FROM s WHERE rn <= 4 AND full_score > 0) SELECT project, name, full_score AS score, position FROM f WHERE position <= 2""")
def _(t: Tables):
    docs = t.lines.groupBy("project", F.col("source_document").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum("row_number").alias("s"), (F.max("document_no") % 5).alias("m"))
    out = rk.two_stage_topk(docs, "project", "name", F.col("n"), F.col("s"), F.when(F.col("m") == 0, 80).otherwise(0), 2)
    return out.select("project", "name", "score", "position")


@query("g8_guard_route", cte("lines") + """, c AS (SELECT project, document_no AS document_id, source_document AS document_name, CASE WHEN document_no % 5 = 0 THEN 80 ELSE 0 END AS priority, CAST(sum(row_number) AS BIGINT) AS score FROM lines GROUP BY ALL), b AS (SELECT project, arg_max(document_id, (priority, score, -document_id)) AS best FROM c WHERE priority > 0 GROUP BY project),
  r AS (SELECT project, min(document_no) AS document_id FROM lines GROUP BY project)
  SELECT r.project, CASE WHEN best IS NOT NULL AND r.document_id % 5 <> 0 THEN best ELSE r.document_id END AS document_id, CAST(CASE WHEN best IS NOT NULL AND r.document_id % 5 <> 0 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence, best IS NOT NULL AND r.document_id % 5 <> 0 AS overridden FROM r LEFT JOIN b ON b.project = r.project""")
def _(t: Tables):
    c = t.lines.groupBy("project", F.col("document_no").alias("document_id"), F.col("source_document").alias("document_name")).agg(F.sum("row_number").alias("score")).withColumn("priority", F.when(F.col("document_id") % 5 == 0, 80).otherwise(0))
    # Document numbers sort like the names only when padded.
    c = c.withColumn("document_name", F.lpad(F.col("document_id").cast("string"), 9, "0"))
    route = t.lines.groupBy("project").agg(F.min("document_no").alias("document_id")).withColumn("confidence", F.lit(0.9))
    return rk.guard_route(route, c, "project")


@query("g9_list_recent", cte("tenders") + " SELECT row_key, deadline_iso AS day FROM tenders WHERE segment <> 'BUILDING' AND deadline_iso >= '2001-07-18' UNION ALL (SELECT row_key, deadline_iso FROM tenders WHERE segment = 'BUILDING' ORDER BY customer_no DESC, deadline_iso DESC, row_key LIMIT 50)")
def _(t: Tables):
    rows = t.tenders.select("row_key", F.col("deadline_iso").alias("day"), F.col("customer_no").alias("at"), F.when(F.col("segment") == "BUILDING", "ARCHIVED").otherwise("VISIBLE").alias("status"))
    recent = rk.list_recent(rows, "day", "at", "row_key", F.date_format(F.date_sub(F.lit("2001-08-01").cast("date"), 14), "yyyy-MM-dd"))
    return recent.select("row_key", "day").unionByName(rk.list_archived(rows, "at", "day", "row_key", 50).select("row_key", "day"))


@query("h1_union_of_sources", cte("tenders") + " SELECT row_key, title, NULL AS place FROM tenders WHERE official UNION ALL SELECT row_key, NULL, place FROM tenders WHERE NOT official")
def _(t: Tables):
    return rk.union_sources(t.tenders.filter("official").select("row_key", "title"), t.tenders.filter("NOT official").select("row_key", "place"))


def _ab(t: Tables):
    return t.tenders.filter("official").select("customer_no"), t.tenders.filter("place = 'ASIA'").select("customer_no")


_A, _B = "SELECT customer_no FROM tenders WHERE official", "SELECT customer_no FROM tenders WHERE place = 'ASIA'"


@query("h2_intersection", cte("tenders") + f" {_A} INTERSECT {_B}")
def _(t: Tables):
    return rk.id_intersection(*_ab(t))


@query("h3_difference", cte("tenders") + f" {_A} EXCEPT {_B}")
def _(t: Tables):
    return rk.id_difference(*_ab(t))


@query("h4_distinct_union", cte("tenders") + f" {_A} UNION {_B}")
def _(t: Tables):
    return rk.id_union(*_ab(t))


@query("h5_subset_test", cte("tenders") + f" SELECT customer_no, bool_and(order_status IN ('F', 'O')) AS is_subset, count(*) AS n FROM tenders GROUP BY customer_no")
def _(t: Tables):
    allowed = t.tenders.filter("order_status in ('F', 'O')").select("order_status")
    return rk.subset_by_group(t.tenders, "customer_no", "order_status", allowed)
