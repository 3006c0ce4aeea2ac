"""Queries for state tables (B*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltion.catalog.base import Tables, cte, query
from deltion.operators import state

# Two states of a keyed table from the source checks: before and since a day.
_OLD = "SELECT source_id, family, max(run_no) AS last_run, max(cents) AS cents, min(day) AS first_seen, max(day) AS last_seen FROM {runs} WHERE day < '2024-01-16' GROUP BY source_id, family"
_NEW = "SELECT source_id, family, max(run_no) AS last_run, CASE WHEN max(cents) % 3 = 0 THEN NULL ELSE max(cents) END AS cents, min(day) AS first_seen, max(day) AS last_seen FROM {runs} WHERE day >= '2024-01-14' AND family <> 'view' GROUP BY source_id, family"
_SQL = cte("runs") + f", o AS ({_OLD.format(runs='runs')}), n AS ({_NEW.format(runs='runs')})"
KEYS = ["source_id", "family"]


def _both(t: Tables):
    return t.sql(_OLD), t.sql(_NEW)


@query("b1_upsert_replace", _SQL + """ SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.family, o.family) AS family, CASE WHEN n.last_run IS NOT NULL THEN n.last_run ELSE o.last_run END AS last_run,
  CASE WHEN n.last_run IS NOT NULL THEN n.cents ELSE o.cents END AS cents, CASE WHEN n.last_run IS NOT NULL THEN n.first_seen ELSE o.first_seen END AS first_seen, CASE WHEN n.last_run IS NOT NULL THEN n.last_seen ELSE o.last_seen END AS last_seen
  FROM o FULL JOIN n ON o.source_id = n.source_id AND o.family = n.family""")
def _(t: Tables):
    return state.upsert_replace(*_both(t), KEYS)


@query("b2_upsert_coalesce", _SQL + """ SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.family, o.family) AS family, CASE WHEN n.last_run IS NOT NULL THEN n.last_run ELSE o.last_run END AS last_run,
  coalesce(n.cents, o.cents) AS cents, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen FROM o FULL JOIN n ON o.source_id = n.source_id AND o.family = n.family""")
def _(t: Tables):
    return state.upsert_coalesce(*_both(t), KEYS, always=["last_run"], keep=["first_seen"])


@query("b3_upsert_first_last_seen", _SQL + """ SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.family, o.family) AS family, coalesce(o.first_seen, n.first_seen) AS first_seen, CASE WHEN n.last_run IS NOT NULL THEN n.last_seen ELSE o.last_seen END AS last_seen
  FROM o FULL JOIN n ON o.source_id = n.source_id AND o.family = n.family""")
def _(t: Tables):
    old, new = _both(t)
    columns = [*KEYS, "first_seen", "last_seen"]
    return state.upsert_first_last_seen(old.select(*columns), new.select(*columns), KEYS)


@query("b3_seen_from_events", cte("runs") + " SELECT source_id, family, min(day) AS first_seen, max(day) AS last_seen FROM runs GROUP BY source_id, family")
def _(t: Tables):
    return state.seen_from_events(t.runs, KEYS, "day")


@query("b4_insert_ignore", _SQL + """ SELECT source_id, family, 'old' AS origin FROM o UNION ALL SELECT source_id, family, 'new' FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source_id = n.source_id AND o.family = n.family)""")
def _(t: Tables):
    old, new = _both(t)
    return state.insert_ignore(old.select(*KEYS, F.lit("old").alias("origin")), new.select(*KEYS, F.lit("new").alias("origin")), KEYS)


@query("b5_replace_slice", cte("lines") + """, s AS (SELECT DISTINCT project, document_no FROM lines WHERE flag = 'A')
  SELECT project, document_no, row_number, line_id, 'kept' AS origin FROM lines l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.project = l.project AND s.document_no = l.document_no)
  UNION ALL SELECT project, document_no, row_number, line_id, 'fresh' FROM lines WHERE flag = 'A'""")
def _(t: Tables):
    cols = ["project", "document_no", "row_number", "line_id"]
    fresh = t.lines.filter("flag = 'A'").select(*cols, F.lit("fresh").alias("origin"))
    return state.replace_slice(t.lines.select(*cols, F.lit("kept").alias("origin")), fresh, ["project", "document_no"])


@query("b6_delete_stale_links", cte("tenders") + """, e AS (SELECT DISTINCT customer_no, linked_id FROM tenders WHERE linked_id IS NOT NULL)
  SELECT e.customer_no, e.linked_id FROM e WHERE e.customer_no NOT IN (SELECT customer_no FROM tenders WHERE segment = 'BUILDING') OR EXISTS (SELECT 1 FROM tenders t WHERE t.customer_no = e.customer_no AND t.linked_id = e.linked_id AND t.place = 'ASIA')""")
def _(t: Tables):
    links = t.tenders.filter("linked_id is not null").select("customer_no", "linked_id").distinct()
    keep = t.tenders.filter("place = 'ASIA'").select("customer_no", "linked_id")
    return state.delete_stale_links(links, keep, t.tenders.filter("segment = 'BUILDING'"), "customer_no", "linked_id")


_STATE_OLD = "SELECT source_id, CAST(max(cents) AS STRING) AS fingerprint, max(day) AS last_checked_at, min(day) AS last_changed_at, 'CHANGED' AS last_status FROM {runs} WHERE day = '2024-01-15' GROUP BY source_id"
_STATE_NEW = "SELECT source_id, CASE WHEN max(user_id) % 5 = 0 THEN NULL ELSE CAST(max(cents) AS STRING) END AS fingerprint, max(day) AS last_checked_at, 'SEEN' AS last_status FROM {runs} WHERE day IN ('2024-01-15', '2024-01-16') AND family <> 'view' GROUP BY source_id"


@query("b7_upsert_change_tracked", cte("runs") + f", o AS ({_STATE_OLD.format(runs='runs')}), n AS ({_STATE_NEW.format(runs='runs')})" + """
  SELECT coalesce(n.source_id, o.source_id) AS source_id, CASE WHEN n.source_id IS NOT NULL THEN n.fingerprint ELSE o.fingerprint END AS fingerprint, coalesce(n.last_checked_at, o.last_checked_at) AS last_checked_at,
    CASE WHEN n.fingerprint IS NOT NULL AND n.fingerprint IS DISTINCT FROM o.fingerprint THEN n.last_checked_at ELSE o.last_changed_at END AS last_changed_at, coalesce(n.last_status, o.last_status) AS last_status FROM o FULL JOIN n ON o.source_id = n.source_id""")
def _(t: Tables):
    return state.upsert_change_tracked(t.sql(_STATE_OLD), t.sql(_STATE_NEW), "source_id")


_ATT = "SELECT project AS tender_id, source_document AS name, line_id AS id, CASE WHEN flag = 'A' THEN 'f' END AS local_path, CASE WHEN flag <> 'N' THEN 's' END AS sha256, flag = 'R' AS is_latest FROM {lines}"


@query("b8_reimport_latest", cte("lines") + f", a AS ({_ATT.format(lines='lines')})" + """, l AS (SELECT DISTINCT tender_id, name FROM a WHERE is_latest UNION SELECT DISTINCT tender_id, 'new.pdf' FROM a WHERE local_path IS NOT NULL),
  p AS (SELECT tender_id, name, id, row_number() OVER (PARTITION BY tender_id, name ORDER BY CASE WHEN local_path IS NOT NULL AND sha256 IS NOT NULL THEN 0 ELSE 1 END, id DESC) AS rn FROM a SEMI JOIN l USING (tender_id, name))
  SELECT a.tender_id, a.name, a.id, CASE WHEN a.tender_id IN (SELECT tender_id FROM l) THEN p.id IS NOT NULL ELSE a.is_latest END AS is_latest FROM a LEFT JOIN (SELECT * FROM p WHERE rn = 1) p ON p.id = a.id AND p.tender_id = a.tender_id AND p.name = a.name
  UNION ALL SELECT tender_id, name, NULL, true FROM l WHERE name = 'new.pdf'""")
def _(t: Tables):
    att = t.sql(_ATT)
    # Ids of the stand-in repeat between tenders, so the id is made unique by its tender and name.
    att = att.withColumn("id", F.struct("tender_id", "name", "id"))
    listing = att.filter("is_latest").select("tender_id", "name").unionByName(att.filter("local_path is not null").select("tender_id", F.lit("new.pdf").alias("name")).distinct())
    return state.reimport_latest(att, listing).select("tender_id", "name", F.col("id.id").alias("id"), "is_latest")


@query("b9_upsert_tender", cte("tenders") + """
  SELECT official_id AS eshidis_id, CASE WHEN place = 'ASIA' THEN title ELSE authority END AS title, CASE WHEN place = 'ASIA' AND segment <> 'BUILDING' THEN 'ACTIVE' WHEN place = 'ASIA' THEN 'ACTIVE' ELSE 'UNKNOWN' END AS status,
    CAST(CASE WHEN place = 'ASIA' THEN 0.5 ELSE 0 END AS DOUBLE) AS status_confidence, CASE WHEN place = 'ASIA' THEN '2020' ELSE '2021' END AS created_at, CASE WHEN segment = 'BUILDING' OR place <> 'ASIA' THEN '2021' ELSE '2020' END AS updated_at
  FROM tenders WHERE place = 'ASIA' OR segment = 'BUILDING'""".replace("CASE WHEN place = 'ASIA' THEN title ELSE authority END AS title", "CASE WHEN segment = 'BUILDING' THEN authority ELSE title END AS title"))
def _(t: Tables):
    fields = "official_id AS eshidis_id"
    old = t.sql(f"SELECT {fields}, title, 'ACTIVE' AS status, CAST(0.5 AS DOUBLE) AS status_confidence, '2020' AS created_at, '2020' AS updated_at FROM {{tenders}} WHERE place = 'ASIA'")
    new = t.sql(f"SELECT {fields}, authority AS title, '2021' AS created_at, '2021' AS updated_at FROM {{tenders}} WHERE segment = 'BUILDING'")
    return state.upsert_tender(old, new)


_DOCS = "SELECT doc_id, source, CASE WHEN doc_id % 4 <> 0 THEN 'f' END AS local_path, n_chars AS size_bytes, 's' AS sha256 FROM {documents}"


@query("b10_clear_expired_payload", """SELECT count(*) FILTER (g AND doc_id % 4 <> 0) AS records, CAST(coalesce(sum(n_chars) FILTER (g AND doc_id % 4 <> 0), 0) AS BIGINT) AS bytes,
  count(*) FILTER (doc_id % 4 <> 0 AND NOT g) AS left_over FROM (SELECT *, source IN ('src1', 'src2', 'src3') AS g FROM documents)""")
def _(t: Tables):
    expired = t.documents.filter(F.col("source").isin("src1", "src2", "src3")).select("source")
    cleared = state.clear_expired_payload(t.sql(_DOCS), expired, "source")
    totals = state.clear_summary(cleared).withColumn("_one", F.lit(1))
    left = cleared.agg(F.count("local_path").alias("left_over")).withColumn("_one", F.lit(1))
    return totals.join(left, "_one").drop("_one")


@query("b11_append_run", cte("runs") + """, r AS (SELECT user_id AS run, run_no, status FROM runs WHERE day < '2024-01-20' UNION ALL SELECT user_id, run_no, 'DONE' FROM runs WHERE day >= '2024-01-20')
  SELECT run, min(run_no) AS started_at, max(run_no) AS updated_at, arg_max(status, run_no) AS status FROM r GROUP BY run""")
def _(t: Tables):
    log = t.runs.filter("day < '2024-01-20'").select(F.col("user_id").alias("run"), "run_no", "status")
    late = t.runs.filter("day >= '2024-01-20'").select(F.col("user_id").alias("run"), "run_no", F.lit("DONE").alias("status"))
    return state.latest_run_state(state.append_run(log, late), "run", "run_no", ["status"])


@query("b12_append_capped", cte("runs") + " SELECT run_no, status FROM runs ORDER BY run_no DESC LIMIT 200")
def _(t: Tables):
    cols = ["run_no", "status"]
    return state.append_capped(t.runs.filter("day < '2024-01-29'").select(*cols), t.runs.filter("day >= '2024-01-29'").select(*cols), ["run_no"], 200)


@query("b13_insert_hits", """SELECT 'run-1' AS run_id, doc_id, '{"lang":"' || lang || '","source":"' || source || '"}' AS provenance FROM documents WHERE contains(text, 'that the')""")
def _(t: Tables):
    hits = t.documents.filter(F.col("text").contains("that the"))
    return state.insert_hits(hits, F.lit("run-1"), ["lang", "source"], ["doc_id"])


@query("b14_patch_json", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k, event_type AS audit, event_id % 2 = 0 AS had_object FROM events""")
def _(t: Tables):
    base = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("broken")
    patched = state.patch_json(base, "audit", F.col("event_type"))
    return t.events.select("event_id", patched.alias("p"), (F.col("event_id") % 2 == 0).alias("had_object")).select(
        "event_id", F.get_json_object("p", "$.k").alias("k"), F.get_json_object("p", "$.audit").alias("audit"), "had_object")


@query("b15_verified_links", cte("tenders") + " SELECT row_key, linked_id AS target_id FROM tenders WHERE linked_id IS NOT NULL AND place <> 'ASIA'")
def _(t: Tables):
    ids = F.array_compact(F.array(F.col("linked_id"), F.col("linked_id"), F.lit("x1")))
    return state.verified_links(t.tenders.filter("linked_id is not null"), "row_key", ids, F.col("place") != "ASIA")


@query("b16_merge_document_index", cte("tenders") + """, u AS (SELECT customer_no, 0 AS src, tender_no, title FROM tenders WHERE place <> 'ASIA' UNION ALL SELECT customer_no, 1, tender_no, authority FROM tenders WHERE segment = 'BUILDING')
  SELECT customer_no, arg_max(tender_no, (src, tender_no)) AS tender_no, arg_max(title, (src, tender_no)) AS title FROM u GROUP BY customer_no""")
def _(t: Tables):
    old = t.tenders.filter("place <> 'ASIA'").select("customer_no", "tender_no", "title")
    new = t.tenders.filter("segment = 'BUILDING'").select("customer_no", "tender_no", F.col("authority").alias("title"))
    return state.merge_document_index(old, new, "customer_no", "tender_no")


_DISMISSED = "SELECT row_key, customer_no, 'seen' AS reason FROM {tenders} WHERE segment = 'BUILDING'"
_FEEDBACK = "SELECT row_key, CASE WHEN official THEN 'FORCE_KEEP' ELSE 'CONFIRM_DROP' END AS action, place AS reason FROM {tenders} WHERE place = 'ASIA'"
_OVERRIDES = "SELECT row_key, 'CONFIRM_DROP' AS action, 'old' AS reason FROM {tenders} WHERE segment = 'FURNITURE'"


@query("b18_delete_keys", cte("tenders") + " SELECT row_key, customer_no FROM tenders WHERE segment = 'BUILDING' AND place <> 'ASIA'")
def _(t: Tables):
    return state.delete_keys(t.sql(_DISMISSED), t.tenders.filter("place = 'ASIA'"), ["row_key"]).select("row_key", "customer_no")


@query("b18_apply_feedback", cte("tenders") + """ SELECT row_key, CASE WHEN place = 'ASIA' THEN CASE WHEN official THEN 'FORCE_KEEP' ELSE 'CONFIRM_DROP' END WHEN segment = 'FURNITURE' THEN 'CONFIRM_DROP' END AS action,
  CASE WHEN place = 'ASIA' THEN place WHEN segment = 'FURNITURE' THEN 'old' END AS reason, segment = 'BUILDING' AND NOT (place = 'ASIA' AND official) AS dismissed FROM tenders WHERE place = 'ASIA' OR segment IN ('BUILDING', 'FURNITURE')""")
def _(t: Tables):
    dismissed, overrides = state.apply_feedback(t.sql(_DISMISSED), t.sql(_OVERRIDES), t.sql(_FEEDBACK))
    flag = dismissed.select("row_key", F.lit(True).alias("dismissed"))
    out = overrides.join(flag, "row_key", "full_outer").withColumn("dismissed", F.coalesce("dismissed", F.lit(False)))
    scope = t.tenders.filter("place = 'ASIA' or segment in ('BUILDING', 'FURNITURE')").select("row_key")
    return scope.join(out, "row_key", "left").withColumn("dismissed", F.coalesce("dismissed", F.lit(False))).select("row_key", "action", "reason", "dismissed")


@query("b19_merge_act_chain", cte("tenders") + """ SELECT row_key, CASE WHEN linked_id IS NULL THEN '' ELSE linked_id END || CASE WHEN segment = 'BUILDING' AND linked_id IS DISTINCT FROM official_id THEN CASE WHEN linked_id IS NULL THEN '' ELSE ',' END || official_id ELSE '' END AS linked_ids,
  CASE WHEN segment = 'BUILDING' THEN 'a.pdf,' || official_id || '.pdf' ELSE 'a.pdf' END AS attachments FROM tenders""")
def _(t: Tables):
    index = t.tenders.select("row_key", F.array_compact(F.array("linked_id")).alias("linked_ids"), F.array(F.lit("a.pdf")).alias("attachments"))
    chain = t.tenders.filter("segment = 'BUILDING'").select("row_key", F.array("official_id").alias("linked_ids"), F.array(F.lit("a.pdf"), F.concat("official_id", F.lit(".pdf"))).alias("attachments"))
    return state.merge_act_chain(index, chain, "row_key").select("row_key", F.array_join("linked_ids", ",").alias("linked_ids"), F.array_join("attachments", ",").alias("attachments"))
