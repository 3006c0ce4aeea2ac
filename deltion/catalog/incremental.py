"""Queries for incremental and streaming operators (J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltion.catalog.base import VIEWS, Tables, cte, query
from deltion.functions.codes import signature
from deltion.operators import monitor
from deltion.session import new_path
from deltion.streaming import incremental as inc

L = "long"
_FAM = """, p AS (SELECT DISTINCT family, user_id AS c FROM runs WHERE day = '2024-01-15'), c AS (SELECT DISTINCT family, user_id AS c FROM runs WHERE day = '2024-01-16' AND family <> 'signup'),
  f AS (SELECT x.family, (SELECT count(*) FROM p WHERE p.family = x.family) AS previous_count, (SELECT count(*) FROM c WHERE c.family = x.family) AS current_count, (SELECT count(*) FROM p JOIN c ON p.family = c.family AND p.c = c.c WHERE p.family = x.family) AS overlap, x.family = 'view' AS exhausted FROM (SELECT DISTINCT family FROM runs) x),
  w AS (SELECT *, overlap > 0 OR previous_count = 0 AS reached_previous, overlap > 0 OR previous_count = 0 OR exhausted AS complete FROM f)"""


def _families(t: Tables):
    ids = lambda day: t.runs.filter(F.col("day") == day).select("family", F.col("user_id").cast("string").alias("candidate_id"))
    exhausted = t.runs.select("family").distinct().withColumn("exhausted", F.col("family") == "view")
    return monitor.overlap_watermark(ids("2024-01-15"), ids("2024-01-16").filter("family <> 'signup'"), exhausted)


@query("j1_overlap_watermark", cte("runs") + _FAM + " SELECT * FROM w")
def _(t: Tables):
    return _families(t)


@query("j1_watermark_status", cte("runs") + _FAM + " SELECT bool_and(complete) AS complete, CASE WHEN bool_and(complete) THEN 'PREVIOUS_WINDOW_REACHED_OR_SOURCE_EXHAUSTED' ELSE 'NEEDS_DEEPER_BACKFILL' END AS stop_reason FROM w")
def _(t: Tables):
    return monitor.watermark_status(_families(t))


@query("j1_run_record", cte("runs") + _FAM + " SELECT CAST(sum(CASE WHEN family = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(current_count) AS BIGINT) AS candidate_ids, bool_and(complete) AS complete, CASE WHEN bool_and(complete) THEN 'PREVIOUS_WINDOW_REACHED_OR_SOURCE_EXHAUSTED' ELSE 'NEEDS_DEEPER_BACKFILL' END AS stop_reason, false AS source_success, false AS success FROM w")
def _(t: Tables):
    families = _families(t)
    counts = families.select("family", F.when(F.col("family") == "error", 1).otherwise(0).alias("errors"), F.col("current_count").alias("ids"))
    return monitor.run_record(counts, monitor.watermark_status(families))


_PREV = "SELECT source_id, CAST(max(cents) AS STRING) AS fingerprint FROM {runs} WHERE day = '2024-01-15' GROUP BY source_id"
_CURR = "SELECT source_id, CAST(max(cents) AS STRING) AS fingerprint FROM {runs} WHERE day IN ('2024-01-15', '2024-01-16') AND family <> 'error' GROUP BY source_id"
_PC = cte("runs") + f", p AS ({_PREV.format(runs='runs')}), c AS ({_CURR.format(runs='runs')})"


@query("j2_changed_sources", _PC + " SELECT c.source_id FROM c LEFT JOIN p ON p.source_id = c.source_id WHERE c.fingerprint IS DISTINCT FROM p.fingerprint")
def _(t: Tables):
    return monitor.changed_sources(t.sql(_PREV), t.sql(_CURR))


_FACTS = """, j AS (SELECT p.fingerprint AS pf, c.fingerprint AS cf FROM p FULL JOIN c ON p.source_id = c.source_id) SELECT count(pf) AS previous_sources, count(cf) AS current_sources, count(*) FILTER (pf IS NOT NULL AND cf IS NOT NULL) AS overlap, count(*) FILTER (cf IS NOT NULL AND cf IS DISTINCT FROM pf) AS changed,
  count(*) FILTER (pf IS NOT NULL AND cf IS NOT NULL AND cf <> pf) AS changed_known"""


@query("j2_change_preflight", _PC + _FACTS + ", (SELECT count(*) FROM runs WHERE family = 'error' AND day = '2024-01-16') AS errors, 'CHANGED_OR_NO_BASELINE' AS status, false AS skip FROM j")
def _(t: Tables):
    errors = t.runs.filter("family = 'error' and day = '2024-01-16'").select("source_id")
    return monitor.change_preflight(t.sql(_PREV), t.sql(_CURR), errors)


@query("j2_preflight_unchanged", cte("runs") + f", p AS ({_PREV.format(runs='runs')}), c AS (SELECT * FROM p WHERE source_id <> 'src1')" + _FACTS + ", 1::BIGINT AS errors, 'SKIPPED_UNCHANGED_WITH_SOURCE_WARNINGS' AS status, true AS skip FROM j")
def _(t: Tables):
    previous = t.sql(_PREV)
    errors = t.spark.createDataFrame([("src1",)], "source_id string")
    return monitor.change_preflight(previous, previous.filter("source_id <> 'src1'"), errors)


_CHECKS = """SELECT source_id, run_no AS seq, CASE WHEN family = 'purchase' THEN CAST(cents % 3 AS STRING) ELSE family END AS fingerprint, family <> 'error' AS reachable, false AS requires_identifier, CASE WHEN family = 'error' THEN 'timeout' END AS error, day AS last_checked_at FROM {runs}"""
_INIT = "SELECT source_id, 'view' AS fingerprint, '2023-12-31' AS last_changed_at, '2023-12-31' AS last_checked_at, 'CHANGED' AS last_status, CAST(NULL AS STRING) AS last_error FROM {runs} WHERE family = 'purchase' AND day = '2024-01-02' GROUP BY source_id"
_PERSIST = cte("runs") + f", k AS ({_CHECKS.format(runs='runs')}), s AS ({_INIT.format(runs='runs')})" + """, n AS (SELECT source_id, arg_max(fingerprint, seq) AS fp, arg_max(reachable, seq) AS ok, max(last_checked_at) AS at, arg_max(coalesce(error, '-'), seq) AS err FROM k GROUP BY source_id)
  SELECT n.source_id, CASE WHEN ok THEN fp ELSE s.fingerprint END AS fingerprint, CASE WHEN ok AND fp IS DISTINCT FROM s.fingerprint THEN n.at ELSE s.last_changed_at END AS last_changed_at, n.at AS last_checked_at,
    CASE WHEN NOT ok THEN 'ERROR' WHEN fp IS NOT DISTINCT FROM s.fingerprint THEN 'SKIPPED_UNCHANGED' ELSE 'CHANGED' END AS last_status, nullif(err, '-') AS last_error FROM n LEFT JOIN s ON s.source_id = n.source_id"""


@query("j3_persist_preflight", _PERSIST)
def _(t: Tables):
    from deltion.operators.ranking import latest_per_key

    return monitor.persist_preflight(latest_per_key(t.sql(_CHECKS), "source_id", "seq"), t.sql(_INIT))


def _stream(t: Tables):
    """The runs view over events as they land."""
    events = inc.read_landed(t.spark, t.folder, "events.parquet", t.events.schema)
    return t.spark.sql(VIEWS["runs"], events=events)


@query("j3_preflight_stream", _PERSIST)
def _(t: Tables):
    base, initial = new_path(t.spark, "preflight"), t.sql(_INIT)
    inc.preflight_batches(t.spark.sql(_CHECKS, runs=_stream(t)), base, initial)
    return inc.last_state(t.spark, base, initial.schema)


@query("j4_incremental_pending", cte("triage") + """ SELECT d.doc_id, t.doc_id IS NULL OR t.toxic = 1 AS pending, CASE WHEN t.doc_id IS NULL THEN CASE WHEN d.lang = 'de' THEN 'DROP_ADMIN' ELSE 'REVIEW_TENDER_CANDIDATE' END WHEN t.toxic = 1 THEN CASE WHEN d.lang = 'de' THEN 'DROP_ADMIN' ELSE 'REVIEW_TENDER_CANDIDATE' END ELSE t.decision END AS decision,
  CAST(CASE WHEN t.doc_id IS NULL OR t.toxic = 1 THEN CASE WHEN d.lang = 'de' THEN 0.8 ELSE 0 END ELSE t.confidence END AS DOUBLE) AS confidence FROM documents d LEFT JOIN triage t ON t.doc_id = d.doc_id""")
def _(t: Tables):
    rows = t.documents.select("doc_id", "lang", signature(F.col("doc_id"), F.col("lang")).alias("sig"))
    old = t.triage.join(rows, "doc_id").select("doc_id", "decision", "confidence", F.when(F.col("toxic") == 1, "stale").otherwise(F.col("sig")).alias("sig"))
    split = monitor.split_pending(rows, old, "doc_id", "sig")
    fresh = split.filter("pending and lang = 'de'").select("doc_id", F.lit("DROP_ADMIN").alias("decision"), F.lit(0.8).alias("confidence"))
    return monitor.merge_labels(split, old, fresh, "doc_id").select("doc_id", "pending", "decision", "confidence")


@query("j5_visible_window", cte("tenders") + " SELECT row_key, CASE WHEN segment = 'BUILDING' THEN 'REJECTED' WHEN deadline_iso < '2001-07-18' THEN 'ARCHIVED' ELSE 'VISIBLE' END AS status, segment <> 'BUILDING' AND deadline_iso < '2001-07-18' AS archived_now FROM tenders")
def _(t: Tables):
    rows = t.tenders.select("row_key", F.col("deadline_iso").cast("date").alias("day"), F.when(F.col("segment") == "BUILDING", "REJECTED").otherwise("VISIBLE").alias("status"))
    return monitor.archive_visible(rows, "day", F.lit("2001-08-01").cast("date")).select("row_key", "status", "archived_now")


@query("j5_reusable_decisions", cte("tenders") + " SELECT row_key, place <> 'ASIA' AND order_status <> 'F' AND NOT (segment = 'BUILDING') AS reuse FROM tenders")
def _(t: Tables):
    rows = t.tenders.select(F.col("row_key").alias("ada"), F.concat(F.lit("u/"), "official_id").alias("document_url"), "place", "order_status", "segment")
    stored = rows.select("ada", F.when(F.col("place") == "ASIA", "other").otherwise(F.col("document_url")).alias("document_url"), F.when(F.col("order_status") == "F", "ARCHIVED").otherwise("VISIBLE").alias("status"), F.when(F.col("segment") == "BUILDING", "").otherwise("text").alias("text_sample"))
    return monitor.reusable_decisions(rows, stored).select(F.col("ada").alias("row_key"), "reuse")


@query("j5_window_stream", """WITH m AS (SELECT max(ts) - INTERVAL 14 DAY AS mark FROM events) SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS records FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY 1""")
def _(t: Tables):
    events = inc.read_landed(t.spark, t.folder, "events.parquet", t.events.schema).select(F.col("ts").cast("timestamp").alias("ts"))
    out = inc.drain(t.spark, inc.visible_window_stream(events, "ts", 15), "window")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "records")


_DATED = "SELECT run_no, CAST(day AS DATE) AS day, CASE WHEN family = 'error' THEN 'REJECTED' ELSE 'VISIBLE' END AS status FROM {runs}"


@query("j5_archive_stream", cte("runs") + f", r AS ({_DATED.format(runs='runs')})" + """ SELECT run_no, day, CASE WHEN status = 'VISIBLE' AND day < (SELECT max(day) FROM r) - INTERVAL 14 DAY THEN 'ARCHIVED' ELSE status END AS status FROM r""")
def _(t: Tables):
    base, rows = new_path(t.spark, "window"), t.spark.sql(_DATED, runs=_stream(t))
    inc.archive_stream(rows, "day", base)
    return inc.read_window(t.spark, base, rows.schema, "day").select("run_no", "day", "status")


@query("j6_stamp_first_seen", cte("runs") + " SELECT source_id, family, min(day) AS first_seen, max(day) AS last_seen FROM runs GROUP BY source_id, family")
def _(t: Tables):
    base, keys = new_path(t.spark, "seen"), ["source_id", "family"]
    inc.stamp_first_seen(_stream(t), keys, "day", base)
    return inc.read_first_seen(t.spark, keys, base, inc.first_seen_stream(t.runs, keys, "day").schema)


@query("j7_notify_once", cte("runs") + " SELECT DISTINCT source_id, family FROM runs")
def _(t: Tables):
    ledger = new_path(t.spark, "ledger")
    stream = _stream(t).select("source_id", "family", F.col("ts").cast("timestamp").alias("ts"))
    inc.notify_once(stream, ["source_id", "family"], ledger)
    return t.spark.read.parquet(ledger).select("source_id", "family")


@query("j8_attempt_ledger", cte("tenders") + " SELECT row_key, CASE WHEN segment = 'BUILDING' THEN 'new' ELSE 'old' END AS signature FROM tenders WHERE place = 'ASIA' OR segment = 'BUILDING'")
def _(t: Tables):
    ledger = t.tenders.filter("place = 'ASIA'").select("row_key", F.lit("old").alias("signature"))
    return monitor.attempt_ledger(ledger, t.tenders.filter("segment = 'BUILDING'").select("row_key", F.lit("new").alias("signature")))


@query("j9_selective_refresh_plan", cte("runs") + " SELECT DISTINCT source_id FROM runs WHERE family = 'purchase' AND day = '2024-01-05'")
def _(t: Tables):
    sources = t.runs.select("source_id").distinct()
    changed = t.runs.filter("family = 'purchase' and day = '2024-01-05'").select("source_id").distinct()
    return monitor.refresh_sources(sources, changed, sources, True)


@query("j10_reuse_document", cte("lines") + " SELECT project, document_no, row_number, line_id, flag = 'A' AND row_number > 1 AND unit_price IS NOT NULL AS reuse FROM lines")
def _(t: Tables):
    keys = ["project", "document_no", "row_number", "line_id"]
    wanted = t.lines.select(*keys, signature(F.col("description")).alias("source_signature"))
    stored = t.lines.select(*keys, F.when(F.col("flag") == "A", signature(F.col("description"))).otherwise("x").alias("source_signature"), F.when(F.col("unit_price").isNull(), "404").alias("fetch_error"), F.when(F.col("row_number") > 1, "p").alias("local_path"), F.lit("s").alias("sha256"))
    return monitor.reuse_document(wanted, stored.dropDuplicates(keys), keys).select(*keys, "reuse")
