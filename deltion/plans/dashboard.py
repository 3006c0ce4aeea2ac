"""K2 dashboard, K3 hidden audit, K4 reverse search, K8 explanations, K9 digest.

Row columns: row_key, source, official, official_id, registry_id, title, authority, place, budget,
deadline, linked_ids; every step adds columns or filters, so a plan stays one lazy job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion import vocab
from deltion.functions.dates import display, sort_key
from deltion.functions.extract import identity, official_url, payment_title
from deltion.functions.text import fold_term, haystack, let, norm_text, snippet, unnest
from deltion.operators import filters, links
from deltion.operators.aggregates import funnel
from deltion.operators.ranking import attention_buckets, document_rank, sort_hidden, sort_rows, top_per_key
from deltion.rules import Scope, UserProfile, for_each_rule
from deltion.session import settle


@dataclass
class Inputs:
    """Tables a dashboard is made from."""

    rows: DataFrame
    dismissed: DataFrame  # row_key
    overrides: DataFrame  # row_key, action
    triage: DataFrame  # row_key, decision, confidence, keep
    links: DataFrame  # row_key, target_id
    evidence: DataFrame | None = None  # see links.attach_document_evidence
    evidence_documents: int = 4  # of each row that are shown
    towns: Sequence[Scope] = ()
    regions: Sequence[Scope] = ()
    taxonomy: Sequence[dict] = field(default_factory=lambda: vocab.TAXONOMY)


def prepared(inp: Inputs) -> DataFrame:
    """K2: all rows with label, evidence, link status, effective deadline and place of interest.

    What is known about a row by itself is written once: both ends of the links and every later step read it, and a filter
    on the place does not search the texts again.
    """
    rows = links.row_facts(inp.rows, inp.dismissed, inp.overrides, inp.triage, inp.links)
    text = F.concat_ws(" ", "title", "authority", "place")
    rows = settle(rows.withColumn("interest_reason", filters.focus_location(text, inp.towns, inp.regions)))
    if inp.evidence is not None:
        rank = document_rank(F.col("name"), F.lit(""), F.size("linked_ids") > 0)
        rows = links.attach_document_evidence(rows, inp.evidence, rank, inp.evidence_documents)
    else:
        rows = rows.withColumn("document_evidence_count", F.lit(0).cast("long")).withColumn("evidence_deadline", F.lit(None).cast("string"))
    rows = links.resolve_targets(rows)
    deadline = filters.effective_deadline(F.col("deadline"), F.col("linked_deadline"), F.col("evidence_deadline"))
    return rows.withColumn("effective_deadline", deadline)


def stages(as_of: Column) -> list[tuple[str, Column]]:
    """K2: what takes a row out, in order."""
    return [
        ("ignored", F.col("ignored")),
        ("duplicate", F.col("duplicate_hidden")),
        ("expired", ~filters.is_active(F.col("effective_deadline"), as_of)),
        ("triage", F.col("triage_hidden")),
        ("out_of_focus", F.col("interest_reason").isNull()),
    ]


def visible_rows(inp: Inputs, as_of: Column, profile: UserProfile | None = None, rows: DataFrame | None = None) -> DataFrame:
    """K2: the rows a user sees, written once and in no order: a sort, a digest and a search read them more than once."""
    rows = prepared(inp) if rows is None else rows
    for _, out in stages(as_of):
        rows = rows.filter(~F.coalesce(out, F.lit(False)))
    return settle(with_profile(rows, inp.taxonomy, profile or UserProfile("")).filter("profile_match.matches"))


def dashboard(inp: Inputs, as_of: Column, profile: UserProfile | None = None, mode: str = "deadline_asc", rows: DataFrame | None = None) -> DataFrame:
    """K2: the rows a user sees, sorted and explained."""
    return sort_rows(explain_rows(visible_rows(inp, as_of, profile, rows)), mode, key="row_key")


def with_profile(rows: DataFrame, taxonomy, profile: UserProfile) -> DataFrame:
    none = filters.taxonomy_labels(F.lit(""), F.lit(""), taxonomy)
    if not profile.active:  # Fits every row: no text is searched.
        return rows.withColumn("profile_match", filters.user_profile_match(F.lit(""), none, F.lit(None).cast("double"), profile))
    labels = filters.taxonomy_labels(F.concat_ws(" ", "title", "authority", "place"), F.lit(""), taxonomy) if profile.category_ids else none
    folded = haystack(*[F.col(c) for c in ("title", "authority", "row_key", "source", "interest_reason")])
    match = let(folded, lambda f: filters.user_profile_match(f, labels, F.col("budget").cast("double"), profile))
    return rows.withColumn("profile_match", match)


def dashboard_funnel(inp: Inputs, as_of: Column) -> DataFrame:
    """Rows per stage."""
    return funnel(prepared(inp), stages(as_of))


def merge_level(official: Column, inbound: Column, verified: Column, linked: Column) -> Column:
    """K8: how a row is tied to other sources."""
    return (
        F.when(official & (inbound > 0), "CANONICAL_WITH_LINKED_SOURCES").when(official, "CANONICAL_SOURCE").when(verified, "VERIFIED_ESHIDIS_LINK")
        .when(linked, "EXTRACTED_ESHIDIS_LINK").otherwise("NO_ESHIDIS_LINK")
    )


def explain_rows(rows: DataFrame) -> DataFrame:
    """K8: identity, merge level, sources, operations, reasons and timeline of each row as arrays."""
    def pair(label: str, text: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), text.alias("text"))

    def listed(*items: Column) -> Column:
        return F.array_compact(F.array(*items))

    shown = display(F.col("effective_deadline"))
    has_deadline = F.coalesce(F.col("effective_deadline"), F.lit("")) != ""
    linked = F.size("linked_ids") > 0
    verified = F.col("link_status").isin("REPLACED_BY_OFFICIAL_ESHIDIS", "VERIFIED_ESHIDIS_LINK_PENDING_OFFICIAL_ROW")
    docs = F.col("document_evidence_count")
    none = F.array().cast("array<string>")
    ident = identity(F.col("registry_id"), none, F.col("linked_ids"), F.col("official_id"), F.col("row_key"), F.col("source"), F.lit(""))
    sources = F.array_distinct(F.concat(F.array(F.concat_ws(" ", "source", "official_id")), F.transform("linked_ids", lambda x: F.concat(F.lit("ΕΣΗΔΗΣ "), x))))
    why = listed(
        pair("Πηγή", F.concat(F.lit("Εντοπίστηκε από "), F.concat_ws(" ", "source", "official_id"), F.lit("."))),
        F.when(F.col("interest_reason").isNotNull(), pair("Περιοχή", F.concat(F.lit("Ταιριάζει με "), "interest_reason", F.lit(".")))),
        pair("Σύνδεση", filters.official_status_label(filters.official_status(F.col("registry_id"), F.col("linked_ids")))),
        F.when(has_deadline, pair("Προθεσμία", F.concat(F.lit("Ενεργή προθεσμία: "), shown, F.lit(".")))),
        F.when(F.col("decision").isNotNull(), pair("AI", F.concat(F.lit("Κρατήθηκε από AI ως "), "decision"))),
        F.when(docs > 0, pair("Έγγραφα", F.concat(F.lit("Υπάρχουν "), docs.cast("string"), F.lit(" κατεβασμένα/ελεγμένα έγγραφα πηγής.")))),
    )
    operations = listed(
        F.when(docs > 0, pair("Έγγραφα", F.lit("ok"))).otherwise(pair("Έγγραφα", F.lit("pending"))),
        F.when(F.col("override_action").isNotNull(), pair("Feedback", F.col("override_action"))),
        F.when(has_deadline, pair("Cleanup", F.lit("scheduled"))),
    )
    timeline = listed(
        pair("Εντοπισμός", F.concat_ws(" ", "source", "official_id")),
        F.when(F.col("interest_reason").isNotNull(), pair("Φίλτρο ενδιαφέροντος", F.col("interest_reason"))),
        F.when(F.col("registry_id").isNotNull() | linked, pair("ΕΣΗΔΗΣ", F.concat(F.lit("Σύνδεση με Α/Α "), F.concat_ws(", ", F.array_union(F.array_compact(F.array("registry_id")), "linked_ids"))))),
        F.when(has_deadline, pair("Προθεσμία", shown)), F.when(F.col("decision").isNotNull(), pair("AI έλεγχος", F.col("decision"))),
        F.when(F.col("override_action").isNotNull(), pair("Feedback", F.col("override_action"))),
    )
    return rows.select(
        "*", sort_key(F.coalesce("effective_deadline", F.lit(""))).alias("deadline_sort"), ident.alias("identity"),
        merge_level(F.col("official"), F.col("inbound_links"), verified, linked).alias("merge_status"), sources.alias("sources"),
        why.alias("why_visible"), operations.alias("operations"), timeline.alias("timeline"),
    )


def hidden_audit(inp: Inputs, as_of: Column, fuzzy: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """K3: why each hidden row is hidden, with the review priority of doubtful ones.

    A row can be hidden for more than one reason: dismissed rows and rows hidden by their label are
    listed apart from the ones the funnel takes out.
    """
    rows = settle(prepared(inp)) if rows is None else rows
    forced = F.coalesce(F.col("override_action") == "FORCE_KEEP", F.lit(False))
    dismissed = rows.filter("dismissed").filter(~forced)
    fields = ["row_key", "official_id", "title", "authority", "decision", "confidence", "override_action", "effective_deadline"]

    def listing(df: DataFrame, category: Column) -> DataFrame:
        return df.select(*fields, category.alias("category"))

    live = rows.filter(~F.col("ignored"))
    labelled = listing(live.filter("triage_hidden"), filters.hidden_category(F.col("decision")))
    duplicates = listing(live.filter("duplicate_hidden"), F.lit("DUPLICATE"))
    inactive = live.filter(~F.col("duplicate_hidden") & ~F.col("triage_hidden") & F.col("interest_reason").isNotNull() & ~filters.is_active(F.col("effective_deadline"), as_of))
    dated = F.coalesce(F.col("effective_deadline"), F.lit("")) != ""
    undated = inactive.filter(~dated)
    category = F.when(filters.out_of_scope_reason(F.col("title"), F.col("official_id")).isNotNull(), "OUT_OF_SCOPE_SUPPLY_SERVICE").otherwise("NO_DEADLINE_EVIDENCE")
    if fuzzy:
        official = live.filter(F.col("official") & ~F.col("duplicate_hidden")).select("registry_id", "title", "authority", "deadline")
        undated = settle(undated)
        wanted = undated.filter("NOT official").select("row_key", "title", "authority", F.col("interest_reason").alias("place"), "linked_ids")
        best = links.fuzzy_best_match(wanted, official).select("row_key", F.col("registry_id").alias("_like"))
        undated = undated.join(best, "row_key", "left")
        category = F.when(F.col("_like").isNotNull(), "DUPLICATE_CANDIDATE").otherwise(category)
    out = (
        listing(dismissed, F.lit("DISMISSED")).unionByName(labelled).unionByName(duplicates)
        .unionByName(listing(inactive.filter(dated), F.lit("EXPIRED"))).unionByName(listing(undated, category))
    )
    scope = filters.out_of_scope_reason(F.col("title"), F.col("official_id"))
    confirmed = F.col("override_action") == "CONFIRM_DROP"
    return out.withColumn("review_priority", filters.review_priority(F.col("category"), F.col("decision"), F.col("confidence"), F.col("title"), F.lit(""), scope, confirmed))


def review_queue(hidden: DataFrame, at: str) -> DataFrame:
    """K3: the rows worth a second look, most urgent first."""
    return sort_hidden(hidden.filter("review_priority is not null").withColumn("display_id", F.col("official_id")), at, "review_priority")


def reverse_search(rows: DataFrame, docs: DataFrame, query: str, max_rows: int | None, max_matches: int | None) -> DataFrame:
    """K4: visible rows whose details or documents contain a text, with snippets.

    docs: row_key, name, text. A query shorter than two characters finds nothing. `max_rows` and `max_matches` are the
    sizes of the page that is wanted; with None all rows and matches come back.
    """
    plain = fold_term(query)
    details = F.concat_ws("\n", *[F.col(c).cast("string") for c in ("row_key", "source", "title", "authority", "place", "interest_reason")])

    def found(df: DataFrame, kind: str, label: Column, text: Column) -> DataFrame:
        spot = let(F.regexp_replace(F.trim(text), r"\s+", " "), lambda flat: let(F.instr(norm_text(flat), F.lit(plain)), lambda pos: F.when(
            pos > 0, F.struct(pos.alias("pos"), snippet(flat, pos, 190, len(plain) + 190, 520).alias("snippet")))))
        hit = unnest(df.select("row_key", label.alias("label"), F.array(spot).alias("_s")), ["row_key", "label"], F.col("_s"), "_h")
        return hit.select("row_key", F.lit(kind).alias("kind"), "label", "_h.snippet")

    if len(query.strip()) < 2 or not plain:
        rows = rows.filter(F.lit(False))
    meta = found(rows, "metadata", F.lit("Στοιχεία έργου"), details)
    active = links.documents_of_active_rows(docs, rows, "row_key")
    inside = found(active, "document", F.col("name"), F.concat_ws("\n", "name", "text"))
    matches = meta.unionByName(inside)
    if max_matches is not None:
        matches = top_per_key(matches, "row_key", [F.col("kind").desc(), F.col("label"), F.col("snippet")], max_matches, rank="match_rank")
    if max_rows is None:
        return matches
    dated = rows.select("row_key", sort_key(F.coalesce("effective_deadline", F.lit(""))).alias("deadline_sort"))
    heads = matches.select("row_key").distinct().join(dated, "row_key").orderBy("deadline_sort", "row_key").limit(max_rows)
    return matches.join(heads.select("row_key"), "row_key", "left_semi")


def digest(rows: DataFrame, profiles: Sequence[UserProfile], log: DataFrame, taxonomy, as_of: Column, channel: str = "email") -> tuple[DataFrame, DataFrame]:
    """K9: new rows per recipient that fit their profile, and the rows of each that need attention.

    `rows` are visible rows without a user profile, in any order; every recipient is served in the same job.
    """
    folded = haystack(*[F.col(c) for c in ("title", "authority", "row_key", "source", "interest_reason")])
    base = rows.withColumn("_f", folded).withColumn("_labels", filters.taxonomy_labels(F.concat_ws(" ", "title", "authority", "place"), F.lit(""), taxonomy))

    def fits(p: UserProfile) -> Column:
        m = filters.user_profile_match(F.col("_f"), F.col("_labels"), F.col("budget").cast("double"), p)
        return F.when(m["matches"], F.struct(F.lit(p.user.strip().lower()).alias("recipient")))

    keep = ["row_key", "title", "budget", "effective_deadline", "registry_id", "linked_ids", "document_evidence_count"]
    matched = for_each_rule(base, list(profiles), fits, keep).withColumn("channel", F.lit(channel))
    sent = log.select("row_key", "channel", F.lower(F.trim("recipient")).alias("recipient")).distinct()
    # The list and its buckets read the new rows; they are found once.
    fresh = settle(matched.join(sent, ["row_key", "channel", "recipient"], "left_anti"))
    days = F.datediff(sort_key(F.col("effective_deadline")).try_cast("date"), as_of)
    has_id = F.col("registry_id").isNotNull() | (F.size("linked_ids") > 0)
    buckets = attention_buckets(fresh, days, F.col("document_evidence_count") > 0, has_id, F.col("budget"), "row_key", ["recipient"], 3)
    return fresh, buckets


def digest_orders(orders: DataFrame, recipients: Sequence[str], log: DataFrame, channel: str = "orders_email") -> DataFrame:
    """K9: visible payment orders that a recipient has not been sent yet; every recipient gets all of them.

    orders: ada, project_title, protocol, issue_date, subject, document_url, matched_keywords. An order without a number (ada) is left out.
    """
    ada = F.trim(F.coalesce("ada", F.lit("")))
    title = F.coalesce(F.nullif("project_title", F.lit("")), payment_title(F.col("protocol"), F.col("issue_date").cast("string"), F.col("subject"), ada))
    rows = orders.filter(ada != "").select(F.concat(F.lit("ENTALMA:"), ada).alias("row_key"), title.alias("title"), "subject", "issue_date", "document_url", "matched_keywords", F.lit(channel).alias("channel"))
    everyone = F.explode(F.array(*(F.lit(r.strip().lower()) for r in recipients))) if recipients else F.explode(F.array().cast("array<string>"))
    sent = log.select("row_key", "channel", F.lower(F.trim("recipient")).alias("recipient")).distinct()
    return rows.select("*", everyone.alias("recipient")).join(sent, ["row_key", "channel", "recipient"], "left_anti")


def digest_summary(fresh: DataFrame, orders: DataFrame, recipients: Sequence[str]) -> DataFrame:
    """K9: new rows, new payment orders and the subject of each recipient's message, also of those who get nothing."""
    everyone = fresh.sparkSession.createDataFrame([(r.strip().lower(),) for r in recipients], "recipient string")
    counted = fresh.select("recipient", F.lit(1).alias("row"), F.lit(0).alias("order")).unionByName(orders.select("recipient", F.lit(0).alias("row"), F.lit(1).alias("order")))
    counted = counted.groupBy("recipient").agg(F.sum("row").alias("new_count"), F.sum("order").alias("new_order_count"))
    out = everyone.join(counted, "recipient", "left").na.fill(0, ["new_count", "new_order_count"])
    parts = F.concat_ws(", ", F.when(F.col("new_count") > 0, F.concat("new_count", F.lit(" νέα έργα"))), F.when(F.col("new_order_count") > 0, F.concat("new_order_count", F.lit(" νέα εντάλματα"))))
    return out.withColumn("subject", F.coalesce(F.nullif(parts, F.lit("")), F.lit("καμία νέα ειδοποίηση")))


def row_url(registry_id: Column, linked_ids: Column, *urls: Column) -> Column:
    """The page a digest points to."""
    first = F.coalesce(F.nullif(registry_id, F.lit("")), F.try_element_at(linked_ids, F.lit(1)))
    return F.coalesce(F.when(first.isNotNull(), official_url(first)), *[F.nullif(u, F.lit("")) for u in urls])
