"""Joins (D*): documents to tenders, overlays, duplicate links, fuzzy matches, evidence.

Equi-joins only. Rules are literals inside the row (`rules.for_each_rule`), similarity joins are
blocked by tokens without losing a match, and many-sided attachments are counted or cut to k
before they are joined, so no group is gathered whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion import vocab
from deltion.functions.dates import NO_DEADLINE, deadline_instant, sort_key
from deltion.functions.numbers import compare_op, number_near
from deltion.functions.text import clean, fold_chars, fold_term, let, norm_text, snippet, title_tokens, token_overlap, unnest
from deltion.operators.ranking import dedupe_similar, top_evidence, top_per_key
from deltion.rules import EvaluationRule, SearchProfile, for_each_rule
from deltion.session import settle


def searchable_documents(docs: DataFrame, attachments: DataFrame, tenders: DataFrame, types: Sequence[str] = (), tender: str | None = None) -> DataFrame:
    """Documents with text, their attachment and tender; optional type and tender filters."""
    with_text = docs.filter(F.length(F.coalesce("text", F.lit(""))) > 0)
    if types:
        with_text = with_text.filter(F.col("document_type").isin(list(types)))
    if tender is not None:
        tenders = tenders.filter(F.col("eshidis_id") == tender)
    return with_text.join(attachments, "attachment_id").join(tenders, "tender_id")


def attachments_with_documents(attachments: DataFrame, docs: DataFrame) -> DataFrame:
    """Latest attachments with their analysis where there is one."""
    return attachments.filter("is_latest").join(docs, "attachment_id", "left")


def rows_with_projects(rows: DataFrame, projects: DataFrame, key: str) -> DataFrame:
    """D3: budget rows with the header of their project."""
    return rows.join(projects, key, "left")


def overlay_merge(authority: DataFrame, notices: DataFrame, discovery: DataFrame, database: DataFrame, key: str, columns: Sequence[str], seq: str) -> DataFrame:
    """Four producers of one row per key: notices overwrite authority rows, discovery replaces
    both, the database overwrites only with values that are not empty. Last of a key wins inside a
    producer. One shuffle: the producers are stacked and reduced map-side.
    """
    producers = {"a": authority, "n": notices, "d": discovery, "b": database}
    stacked = None
    for tag, df in producers.items():
        part = df.select(key, F.lit(tag).alias("_p"), F.struct(seq, *columns).alias("_row"))
        stacked = part if stacked is None else stacked.unionByName(part)
    last = [F.max(F.when(F.col("_p") == tag, F.col("_row"))).alias(f"_{tag}") for tag in producers]
    merged = stacked.groupBy(key).agg(*last)

    def pick(c: str) -> Column:
        base = F.when(F.col("_d").isNotNull(), F.col(f"_d.{c}")).when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_a.{c}"))
        stored = F.col(f"_b.{c}")
        return F.coalesce(F.when(stored.cast("string") != "", stored), base).alias(c)

    origin = F.concat_ws("+", *[F.when(F.col(f"_{t}").isNotNull(), F.lit(t)) for t in producers])
    return merged.select(key, *[pick(c) for c in columns], origin.alias("producers"))


def attach_triage(rows: DataFrame, triage: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Label of each row; FORCE_KEEP makes it visible; rows without a label are visible."""
    t = triage.select(key, "decision", "confidence", "keep")
    o = overrides.select(key, F.col("action").alias("override_action"))
    hidden = F.col("decision").isNotNull() & ~F.coalesce(F.col("keep"), F.lit(False)) & ~F.coalesce(F.col("override_action") == "FORCE_KEEP", F.lit(False))
    return rows.join(t, key, "left").join(o, key, "left").withColumn("triage_hidden", hidden)


def effective_overrides(common: DataFrame, own: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A user's override shadows the common one as a whole."""
    g = common.select(key, F.struct(*columns).alias("_g"))
    u = own.select(key, F.struct(*columns).alias("_u"))
    scope = F.when(F.col("_u").isNotNull(), "user").otherwise("global")
    chosen = F.coalesce("_u", "_g")
    return g.join(u, key, "full_outer").select(key, *[chosen[c].alias(c) for c in columns], scope.alias("scope"))


def ignored_keys(dismissed: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """(dismissed or CONFIRM_DROP) and not FORCE_KEEP."""
    drop = overrides.filter(F.col("action") == "CONFIRM_DROP").select(key)
    keep = overrides.filter(F.col("action") == "FORCE_KEEP").select(key)
    return dismissed.select(key).union(drop).distinct().join(keep, key, "left_anti")


def drop_ignored(rows: DataFrame, dismissed: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """D7."""
    return rows.join(ignored_keys(dismissed, overrides, key), key, "left_anti")


def per_recipient(rows: DataFrame, recipients: Sequence[str]) -> DataFrame:
    """One copy of each row per recipient of a configured list."""
    return rows.withColumn("recipient", F.explode(F.array(*[F.lit(r.strip().lower()) for r in recipients])))


def not_yet_notified(rows: DataFrame, recipients: Sequence[str], log: DataFrame, channel: str = "email") -> DataFrame:
    """Rows never sent to a recipient on a channel."""
    sent = log.select("row_key", "channel", F.lower(F.trim("recipient")).alias("recipient")).distinct()
    return per_recipient(rows, recipients).withColumn("channel", F.lit(channel)).join(sent, ["row_key", "channel", "recipient"], "left_anti")


def documents_of_active_rows(docs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Documents of visible rows."""
    return docs.join(rows.select(key), key, "left_semi")


def linked_ids_missing(rows: DataFrame, ids: str, official: DataFrame, official_id: str) -> DataFrame:
    """Linked ids without an official row."""
    linked = rows.select(F.explode(F.array_distinct(ids)).alias(official_id)).filter(F.col(official_id).rlike(r"^\d+$")).distinct()
    return linked.join(official.select(official_id), official_id, "left_anti")


def strong_duplicate(row: Column, official: Column) -> Column:
    """At least two of equal title, equal deadline, budget within 1, one authority naming the other.

    `row` and `official` are structs with title, deadline, budget, authority.
    """
    def plain(c: Column) -> Column:
        return norm_text(F.coalesce(c, F.lit("")))

    t1, t2, a1, a2 = plain(row["title"]), plain(official["title"]), plain(row["authority"]), plain(official["authority"])
    signs = [
        (t1 != "") & (t1 == t2),
        deadline_instant(row["deadline"]) == deadline_instant(official["deadline"]),
        F.abs(row["budget"] - official["budget"]) <= 1,
        (a1 != "") & (a2 != "") & ((F.instr(a2, a1) > 0) | (F.instr(a1, a2) > 0)),
    ]
    total = F.lit(0)
    for sign in signs:
        total = total + F.coalesce(sign, F.lit(False)).cast("int")
    return total >= 2


def suppress_linked_duplicates(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Link status of every row and whether it is hidden behind an official one.

    rows: row_key, official (bool), registry_id, title, deadline, budget, authority, linked_ids;
    links: row_key, target_id (verified edges). Edges are reduced to counts per row before they
    come back, so a row or target with very many edges is no bottleneck.
    """
    fields = F.struct("title", "deadline", "budget", "authority")
    canonical = rows.filter("official").select(F.col("registry_id").alias("target_id"), fields.alias("_official"))
    verified = links.filter(F.col("target_id").rlike(r"^\d+$")).select("row_key", "target_id", F.lit(True).alias("verified")).distinct()
    extracted = (
        rows.filter("NOT official").select("row_key", fields.alias("_row"), F.explode(F.array_distinct("linked_ids")).alias("target_id"))
    )
    verified_hits = verified.join(canonical.select("target_id", F.lit(True).alias("known")), "target_id", "left").select(
        "row_key", "target_id", F.coalesce("known", F.lit(False)).alias("v_dup"), F.lit(False).alias("s_dup"), F.lit(True).alias("v")
    )
    strong_hits = (
        extracted.join(canonical, "target_id").filter(strong_duplicate(F.col("_row"), F.col("_official")))
        .select("row_key", "target_id", F.lit(False).alias("v_dup"), F.lit(True).alias("s_dup"), F.lit(False).alias("v"))
    )
    per_row = verified_hits.unionByName(strong_hits).groupBy("row_key").agg(
        F.bool_or("v_dup").alias("_v_dup"), F.bool_or("s_dup").alias("_s_dup"), F.bool_or("v").alias("_v"),
        F.min(F.when(F.col("v_dup"), F.col("target_id"))).alias("_v_id"), F.min(F.when(F.col("s_dup"), F.col("target_id"))).alias("_s_id"),
        F.countDistinct(F.when(F.col("v_dup") | F.col("s_dup"), F.col("target_id"))).alias("_dups"),
    )
    inbound = verified.groupBy(F.col("target_id").alias("_in")).agg(F.count(F.lit(1)).alias("inbound_links"))
    status = (
        F.when(F.col("official"), "OFFICIAL_ESHIDIS_ROW").when(F.col("_v_dup"), "REPLACED_BY_OFFICIAL_ESHIDIS")
        .when(F.col("_s_dup"), "STRONG_LINKED_ESHIDIS_DUPLICATE").when(F.col("_v"), "VERIFIED_ESHIDIS_LINK_PENDING_OFFICIAL_ROW")
        .otherwise("NO_VERIFIED_ESHIDIS_LINK")
    )
    hidden = ~F.col("official") & (F.coalesce("_v_dup", F.lit(False)) | F.coalesce("_s_dup", F.lit(False)))
    return (
        # Rows without a registry id have no inbound links; their own key spreads them over the tasks.
        rows.join(per_row, "row_key", "left").withColumn("_in", F.coalesce("registry_id", F.concat(F.lit("row "), "row_key"))).join(inbound, "_in", "left")
        .withColumn("link_status", status).withColumn("duplicate_hidden", hidden)
        .withColumn("duplicate_of", F.when(hidden, F.coalesce("_v_id", "_s_id")))
        .withColumn("duplicate_count", F.when(hidden, F.col("_dups")).otherwise(0))
        .withColumn("inbound_links", F.when(F.col("official"), F.coalesce("inbound_links", F.lit(0))).otherwise(0))
        .drop("_v_dup", "_s_dup", "_v", "_v_id", "_s_id", "_dups", "_in")
    )


def row_facts(rows: DataFrame, dismissed: DataFrame, overrides: DataFrame, triage: DataFrame, links: DataFrame) -> DataFrame:
    """K2: every row with what is known about its key, in one shuffle instead of a join per input.

    Adds dismissed, ignored (D7), decision, confidence, keep, override_action, triage_hidden (D5) and verified_ids, the targets
    of the row's verified edges.
    """
    parts = [
        rows.select("row_key", F.struct(*[c for c in rows.columns if c != "row_key"]).alias("_row")), dismissed.select("row_key", F.lit(True).alias("_dismissed")),
        overrides.select("row_key", "action"), triage.select("row_key", F.struct("decision", "confidence", "keep").alias("_label")),
        links.filter(F.col("target_id").rlike(r"^\d+$")).select("row_key", "target_id"),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    known = stacked.groupBy("row_key").agg(
        F.first("_row", True).alias("_row"), F.coalesce(F.bool_or("_dismissed"), F.lit(False)).alias("dismissed"), F.max("action").alias("override_action"),
        F.first("_label", True).alias("_label"), F.array_sort(F.collect_set("target_id")).alias("verified_ids"),
    )
    action = F.coalesce("override_action", F.lit(""))
    kept = F.coalesce("_label.keep", F.lit(False)) | (action == "FORCE_KEEP")
    return known.filter("_row is not null").select(
        "row_key", "_row.*", "dismissed", "override_action", "verified_ids", "_label.decision", "_label.confidence", "_label.keep",
        ((F.col("dismissed") | (action == "CONFIRM_DROP")) & (action != "FORCE_KEEP")).alias("ignored"), (F.col("_label.decision").isNotNull() & ~kept).alias("triage_hidden"),
    )


def resolve_targets(rows: DataFrame) -> DataFrame:
    """K2: link status, duplicates, inbound links (D11) and linked deadline (D17) of `row_facts`, with one join on the target.

    A resolved edge tells something about both its ends, so one aggregation by key serves rows and official rows alike.
    """
    none = F.array().cast("array<string>")
    fields = F.struct("title", "deadline", "budget", "authority")
    at = sort_key(F.col("deadline"))
    official = rows.filter("official").select(
        F.col("registry_id").alias("target_id"), F.col("row_key").alias("_official_key"), fields.alias("_official"), F.when(~F.col("ignored") & (at != NO_DEADLINE), at).alias("_at")
    )
    edges = rows.select("row_key", "official", fields.alias("_row"), "verified_ids", F.coalesce("linked_ids", none).alias("_linked"))
    edges = edges.withColumn("target_id", F.explode(F.array_union("_linked", "verified_ids")))
    verified, extracted = F.array_contains("verified_ids", F.col("target_id")), ~F.col("official") & F.array_contains("_linked", F.col("target_id"))
    strong = extracted & strong_duplicate(F.col("_row"), F.col("_official"))
    own = F.struct(F.col("row_key").alias("row_key"), F.col("target_id").alias("t"), verified.alias("v"), strong.alias("s"), F.when(extracted, F.col("_at")).alias("at"), F.lit(0).cast("long").alias("inbound"))
    other = F.struct(F.col("_official_key").alias("row_key"), F.lit(None).cast("string").alias("t"), F.lit(False).alias("v"), F.lit(False).alias("s"), F.lit(None).cast("string").alias("at"), verified.cast("long").alias("inbound"))
    facts = edges.join(official, "target_id").select(F.explode(F.array(own, other)).alias("_e")).select("_e.*").groupBy("row_key").agg(
        F.bool_or("v").alias("_v_dup"), F.bool_or("s").alias("_s_dup"), F.min(F.when(F.col("v"), F.col("t"))).alias("_v_id"), F.min(F.when(F.col("s"), F.col("t"))).alias("_s_id"),
        F.count_if(F.col("v") | F.col("s")).alias("_dups"), F.max("at").alias("linked_deadline"), F.sum("inbound").alias("inbound_links"),
    )
    hidden = ~F.col("official") & (F.coalesce("_v_dup", F.lit(False)) | F.coalesce("_s_dup", F.lit(False)))
    status = (
        F.when(F.col("official"), "OFFICIAL_ESHIDIS_ROW").when(F.col("_v_dup"), "REPLACED_BY_OFFICIAL_ESHIDIS").when(F.col("_s_dup"), "STRONG_LINKED_ESHIDIS_DUPLICATE")
        .when(F.size("verified_ids") > 0, "VERIFIED_ESHIDIS_LINK_PENDING_OFFICIAL_ROW").otherwise("NO_VERIFIED_ESHIDIS_LINK")
    )
    return (
        rows.join(facts, "row_key", "left").withColumn("link_status", status).withColumn("duplicate_hidden", hidden)
        .withColumn("duplicate_of", F.when(hidden, F.coalesce("_v_id", "_s_id"))).withColumn("duplicate_count", F.when(hidden, F.col("_dups")).otherwise(0))
        .withColumn("inbound_links", F.when(F.col("official"), F.coalesce("inbound_links", F.lit(0))).otherwise(0)).drop("_v_dup", "_s_dup", "_v_id", "_s_id", "_dups")
    )


# --- fuzzy match -----------------------------------------------------------------------------


def fuzzy_best_match(rows: DataFrame, official: DataFrame, threshold: float = 0.72) -> DataFrame:
    """For each row the official record it most likely duplicates.

    Score = .62 title overlap + .28 authority + .12 place + .5 explicit link, at most 1.
    rows: row_key, title, authority, place, linked_ids; official: registry_id, title, authority, deadline.

    Without a link a score of `threshold` needs a title overlap of at least (threshold - .40)/.62, without a
    place (threshold - .28)/.62, so one of the rarest words of the shorter title must be in the other one: only
    those words are joined on, and equal (title, authority, place) combinations are compared once. Pairs are scored
    where they meet and only the best of a combination goes on; a bit per word rules most of them out before their
    words are compared. Linked pairs come from an equi-join on the id. No pair above the threshold is lost.
    """
    r = settle(rows.select("row_key", F.coalesce("title", F.lit("")).alias("title"), norm_text(F.coalesce("authority", F.lit(""))).alias("auth"),
                           norm_text(F.coalesce("place", F.lit(""))).alias("place"), "linked_ids").withColumn("tok", title_tokens(F.col("title"))).drop("title"))
    o = settle(official.select("registry_id", F.coalesce("title", F.lit("")).alias("o_title"), norm_text(F.coalesce("authority", F.lit(""))).alias("o_auth"),
                               F.coalesce("deadline", F.lit("")).alias("deadline")).withColumn("o_tok", title_tokens(F.col("o_title"))).drop("o_title"))
    if threshold <= 0.40:
        raise ValueError("blocking by words needs a threshold above .40")

    def bits(tok: str) -> Column:
        return F.expr(f"aggregate({tok}, 0L, (b, w) -> b | shiftleft(1L, cast(pmod(xxhash64(w), 64) as int)))")

    number = F.monotonically_increasing_id()
    combos = settle(r.select("tok", "auth", "place").distinct().withColumns({"_l": number, "_bits": bits("tok"), "auth_tok": title_tokens(F.col("auth"))}))
    # Officials with the same words and authority score alike: the latest deadline stands for them.
    o_best = o.groupBy("o_tok", "o_auth").agg(F.max(F.struct("deadline", "registry_id")).alias("_o"))
    o_best = settle(o_best.withColumns({"_r": number, "_o_bits": bits("o_tok"), "o_auth_tok": title_tokens(F.col("o_auth"))}))
    words = combos.select(F.explode("tok").alias("w")).unionByName(o_best.select(F.explode("o_tok").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("df"))

    def rare_first(df: DataFrame, key: str, tok: str, out: str) -> DataFrame:
        """The rows once for each of their words; `out` is the place of the word, rarest first."""
        flat = df.select(key, F.explode(tok).alias("w")).join(words, "w")
        per = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("_all"))  # at most the words of one title
        return df.join(per, key).select(*df.columns, F.posexplode("_all").alias(out, "_s")).withColumn("w", F.col("_s.w")).drop("_s")

    def prefix(size: Column, most: Column) -> Column:
        """How many of the rarest words must hold a shared one, if the rest of the score is `most`."""
        return size - F.ceil((F.lit(threshold) - most) / 0.62 * size - 1e-9) + 1

    left, right = rare_first(combos, "_l", "tok", "_p"), rare_first(o_best, "_r", "o_tok", "_q")
    size, o_size = F.size("tok"), F.size("o_tok")
    most = F.when(F.col("place") != "", 0.40).otherwise(0.28)
    # Only the rare words of the shorter title are joined, so a frequent word meets few partners.
    missing = F.when(size <= o_size, F.bit_count(F.col("_bits").bitwiseAND(F.bitwise_not("_o_bits")))).otherwise(F.bit_count(F.col("_o_bits").bitwiseAND(F.bitwise_not("_bits"))))
    smaller = F.least(size, o_size)
    possible = (smaller - missing) / smaller * 0.62 + most >= threshold - 1e-9
    short_left = left.filter(F.col("_p") < prefix(size, most)).join(right, "w").filter((size <= o_size) & possible)
    short_right = left.join(right.filter(F.col("_q") < prefix(o_size, F.lit(0.40))), "w").filter((size > o_size) & possible)
    blocked = short_left.unionByName(short_right)
    overlap = token_overlap(F.col("tok"), F.col("o_tok"))

    def authority_match() -> Column:
        both = (F.col("auth") != "") & (F.col("o_auth") != "")
        named = both & ((F.instr(F.col("o_auth"), F.col("auth")) > 0) | (F.instr(F.col("auth"), F.col("o_auth")) > 0))
        return named | (token_overlap(F.col("auth_tok"), F.col("o_auth_tok")) >= 0.5)

    part = F.filter(F.split(F.col("place"), "[,/]"), lambda p: p != "")
    place_match = (F.col("place") != "") & (F.col("o_auth") != "") & F.exists(part, lambda p: F.instr(F.col("o_auth"), p) > 0)

    def scored(df: DataFrame, linked: bool) -> DataFrame:
        base = overlap * 0.62 + F.when(authority_match(), 0.28).otherwise(0.0) + F.when(place_match, 0.12).otherwise(0.0)
        signals = F.array_compact(F.array(
            F.when(overlap >= 0.45, F.concat(F.lit("title_overlap "), F.format_string("%.2f", overlap))),
            F.when(authority_match(), F.lit("authority_match")), F.when(place_match, F.lit("location_match")),
            F.lit("explicit_linked_eshidis") if linked else F.lit(None).cast("string"),
        ))
        return df.withColumn("score", F.least(base + (0.5 if linked else 0.0), F.lit(1.0))).withColumn("signals", signals).filter(F.col("score") >= threshold)

    best = F.struct(F.round("score", 3).alias("score"), "deadline", "registry_id", "signals")
    by_words = (
        scored(blocked.filter(authority_match() | place_match), False).select("tok", "auth", "place", "score", "signals", "_o.deadline", "_o.registry_id")
        .groupBy("tok", "auth", "place").agg(F.max(best).alias("_m"))
    )
    linked = r.withColumn("registry_id", F.explode(F.array_distinct("linked_ids"))).join(o, "registry_id")
    linked = linked.withColumns({"auth_tok": title_tokens(F.col("auth")), "o_auth_tok": title_tokens(F.col("o_auth"))})
    by_link = scored(linked, True).groupBy("row_key").agg(F.max(best).alias("_m"))
    candidates = r.join(by_words, ["tok", "auth", "place"]).select("row_key", "_m").unionByName(by_link.select("row_key", "_m"))
    return candidates.groupBy("row_key").agg(F.max("_m").alias("_m")).select("row_key", "_m.registry_id", "_m.score", "_m.deadline", "_m.signals")


# --- rules over documents --------------------------------------------------------------------


def match_terms(docs: DataFrame, profile: SearchProfile, text: str, document_type: str | None, keep: Sequence[str], dedupe: bool = True) -> DataFrame:
    """D14 (+F9): profile terms found in documents with position and evidence.

    exact .90 / optional .65 / code .60; below the minimum confidence nothing is reported.
    """
    kinds = [("exact_phrase", 0.90, profile.exact_phrases), ("optional_term", 0.65, profile.optional_terms), ("revision_code", 0.60, profile.revision_codes)]
    if document_type and profile.document_types:
        docs = docs.filter(F.col(document_type).isin(list(profile.document_types)))
    base = docs.select(*keep, clean(F.coalesce(text, F.lit(""))).alias("_text")).withColumn("_folded", F.translate(fold_chars(F.col("_text")), "_", " "))
    found = []
    for kind, confidence, terms in kinds:
        if confidence < profile.minimum_confidence:
            continue
        for term in terms:
            plain = fold_term(term, underscores=True)
            if not plain:
                continue
            pos = F.instr(F.col("_folded"), F.lit(plain))
            found.append(F.when(pos > 0, F.struct(
                F.lit(kind).alias("match_type"), F.lit(term).alias("term"), F.lit(confidence).alias("confidence"), pos.alias("pos"),
                snippet(F.col("_text"), pos, 180, len(plain) + 180).alias("context"),
            )))
    matches = F.array_compact(F.array(*found))
    hits = dedupe_similar(F.col("_matches")) if dedupe else F.col("_matches")
    return unnest(base.select(*keep, matches.alias("_matches")), keep, hits, "_m").select(*keep, "_m.*")


def evaluate_rules(docs: DataFrame, rules: Sequence[EvaluationRule], text: str, document_type: str | None, keep: Sequence[str]) -> DataFrame:
    """Rule hits of documents: any phrase present (the earliest is the evidence), and where the
    rule has a number, one near the phrase that satisfies it."""
    base = docs.select(*keep, *( [document_type] if document_type and document_type not in keep else []), clean(F.coalesce(text, F.lit(""))).alias("_text"))
    base = base.filter(F.col("_text") != "").withColumn("_folded", F.translate(fold_chars(F.col("_text")), "_", " "))

    def hit(rule: EvaluationRule) -> Column:
        plain = [p for p in (fold_term(x, underscores=True) for x in rule.phrases) if p]
        at = [F.instr(F.col("_folded"), F.lit(p)) for p in plain]
        first = F.least(*[F.when(a > 0, a) for a in at], F.lit(None).cast("int")) if at else F.lit(1)
        wanted = F.col(document_type).isin(list(rule.document_types)) if document_type and rule.document_types else F.lit(True)

        def hit_at(pos: Column, value: Column, context: Column) -> Column:
            return F.struct(
                F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(float(rule.score)).alias("score"),
                pos.alias("pos"), value.alias("numeric_value"), context.alias("context"),
            )

        def found_at(pos: Column, context: Column) -> Column:
            if not rule.operator or rule.threshold is None:
                return hit_at(pos, F.lit(None).cast("double"), context)
            anchor = F.instr(F.translate(fold_chars(context), "_", " "), F.lit(plain[0])) if plain else F.lit(0)
            return let(number_near(context, anchor), lambda value: F.when(
                F.coalesce(compare_op(value, F.lit(rule.operator), F.lit(rule.threshold)), F.lit(False)), hit_at(pos, value, context)))

        # Snippet and number are only taken where a phrase was found, and each once.
        return let(first, lambda pos: F.when(
            pos.isNotNull() & wanted, let(snippet(F.col("_text"), pos, 260, 260), lambda context: found_at(pos, context))))

    return for_each_rule(base, list(rules), hit, list(keep))


# --- evidence, enrichment, names -------------------------------------------------------------


def attach_document_evidence(rows: DataFrame, docs: DataFrame, rank: Column, k: int) -> DataFrame:
    """Up to k best documents per row; a stored document wins over a legacy one of the same url.

    docs: row_key, document_url, name, origin (0 stored, 1 legacy), linked_ids, deadline_key,
    is_extension, confidence, deadline_at.
    """
    unique = top_per_key(docs, ["row_key", "document_url"], [F.col("origin"), F.col("name")])
    best = top_evidence(unique, "row_key", "name", rank, k)
    deadline = F.max(F.when(F.col("deadline_key") != "9999", F.struct("deadline_key", "is_extension", "confidence", "deadline_at")))
    evidence = best.groupBy("row_key").agg(
        F.count(F.lit(1)).alias("document_evidence_count"),
        F.array_sort(F.collect_list(F.struct("position", "name", "document_url"))).alias("document_evidence"),  # at most k
        F.array_distinct(F.flatten(F.collect_list("linked_ids"))).alias("_ids"),
        deadline.alias("_deadline"),
    )
    none = F.array().cast("array<string>")
    ids = F.array_sort(F.filter(F.array_union(F.coalesce("linked_ids", none), F.coalesce("_ids", none)), lambda x: x.rlike(r"^\d+$")))
    own = F.nullif(F.col("deadline"), F.lit(""))
    return (
        rows.join(evidence, "row_key", "left")
        .withColumn("linked_ids", F.when(F.col("document_evidence_count").isNotNull(), ids).otherwise(F.col("linked_ids")))
        .withColumn("evidence_deadline", F.col("_deadline.deadline_at"))
        .withColumn("deadline", F.coalesce(own, F.col("_deadline.deadline_at")))
        .withColumn("document_evidence_count", F.coalesce("document_evidence_count", F.lit(0)))
        .drop("_ids", "_deadline")
    )


def official_deadlines(rows: DataFrame, links: DataFrame, key: str = "row_key") -> DataFrame:
    """Latest deadline among the official rows a row is linked to.

    rows: official rows (registry_id, deadline_sort); links: (row_key, registry_id).
    """
    return links.join(rows.select("registry_id", "deadline_sort"), "registry_id").groupBy(key).agg(F.max("deadline_sort").alias("linked_deadline"))


def enrichment_targets(rows: DataFrame, attempts: DataFrame, canonical: DataFrame, limit: int | None = None) -> DataFrame:
    """Non-official rows to look up: links not all official, signature new or changed.

    rows: row_key, official, official_id, registry_id, linked_ids, signature, has_attachments, display_order.
    """
    open_rows = rows.filter(~F.col("official"))
    linked = open_rows.select("row_key", F.explode("linked_ids").alias("target_id"))
    unknown = (
        linked.join(canonical.select(F.col("registry_id").alias("target_id"), F.lit(True).alias("_known")), "target_id", "left")
        .groupBy("row_key").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("_all_known"))
    )
    identifier = F.coalesce(
        F.try_element_at(F.array_sort("linked_ids"), F.lit(1)),
        F.when(F.col("has_attachments"), F.col("row_key")),
        F.when(F.col("official_id").rlike(r"^\d{2}PROC\d{9}$"), F.col("official_id")),
        F.when(F.col("registry_id").rlike(r"^\d+$"), F.col("registry_id")),
    )
    previous = attempts.select("row_key", F.col("signature").alias("_previous"))
    out = (
        open_rows.join(unknown, "row_key", "left").filter(~F.coalesce("_all_known", F.lit(False)))
        .join(previous, "row_key", "left").filter(~F.coalesce(F.col("signature") == F.col("_previous"), F.lit(False)))
        .withColumn("identifier", identifier).filter(F.col("identifier").isNotNull()).drop("_all_known", "_previous")
    )
    return out.orderBy("display_order", "row_key").limit(limit) if limit else out


def match_by_name(downloads: DataFrame, attachments: DataFrame, owner: str = "tender_id") -> DataFrame:
    """Attachment of each downloaded file: newest of the exact name, else the only one whose
    name agrees after whitespace is collapsed."""
    latest = attachments.filter("is_latest")
    exact = latest.groupBy(owner, "name").agg(F.max("id").alias("_exact"))
    loose = latest.groupBy(owner, clean(F.col("name")).alias("_plain")).agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("_id"))
    loose = loose.filter("_n = 1").select(owner, "_plain", F.col("_id").alias("_loose"))
    joined = downloads.join(exact, [owner, "name"], "left").withColumn("_plain", clean(F.col("name"))).join(loose, [owner, "_plain"], "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "normalized").otherwise("missing")
    return joined.withColumn("attachment_id", F.coalesce("_exact", "_loose")).withColumn("matched_by", how).drop("_exact", "_loose", "_plain")


def carry_forward(current: DataFrame, previous: DataFrame, skipped: DataFrame, key: str, note: str = "SKIPPED_UNCHANGED cached from previous report") -> DataFrame:
    """Rows of skipped sources come from the previous report, with a note."""
    notes = F.when(F.array_contains("match_notes", note), F.col("match_notes")).otherwise(F.array_append("match_notes", F.lit(note)))
    cached = previous.join(skipped.select(key), key, "left_semi").withColumn("match_notes", notes)
    return current.unionByName(cached, allowMissingColumns=True)


def attachment_url(reference: Column, base: str = vocab.FEED_URL) -> Column:
    """Attachment address of an act by the prefix of its number."""
    chain = F
    for prefix, endpoint in vocab.ACT_ENDPOINTS.items():
        chain = chain.when(F.upper(reference).startswith(prefix), F.concat(F.lit(f"{base}{endpoint}/attachment/"), reference))
    return chain


def connected_references(chains: DataFrame, chain: Column, key: str) -> DataFrame:
    """Distinct (reference, act type) of chains given as map<type, array>, in reading order."""
    position = F.array_position(F.array(*[F.lit(a) for a in vocab.ACT_FAMILIES]), F.col("act_type"))
    flat = chains.select(key, F.explode(chain).alias("act_type", "_refs")).select(key, "act_type", F.posexplode("_refs").alias("_i", "reference"))
    flat = flat.withColumn("reference", F.trim("reference")).filter((F.col("reference") != "") & F.col("act_type").isin(vocab.ACT_FAMILIES))
    return flat.groupBy(key, "act_type", "reference").agg(F.min("_i").alias("_i")).withColumn("act_order", position).withColumn(
        "attachment_url", attachment_url(F.col("reference"))
    )


def notification_rollup(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Recipients and latest time a row was sent."""
    sent = log.groupBy(key).agg(F.countDistinct("recipient").alias("recipients"), F.max("sent_at").alias("last_sent_at"))
    return rows.join(sent, key, "left").withColumn("recipients", F.coalesce("recipients", F.lit(0)))


def composite_match(pairs: DataFrame, minimum: int = 4) -> DataFrame:
    """Independent agreements of candidate pairs: authority, place, budget within 1 %, code,
    date within three days, programme. A title alone is never decisive: it is not counted.

    pairs: structs `l` and `r` with those fields (typed).
    """
    left, right = F.col("l"), F.col("r")
    fields = {
        "authority": left["authority"] == right["authority"],
        "place": left["place"] == right["place"],
        "budget": F.abs(left["budget"] - right["budget"]) <= F.greatest(F.abs(left["budget"]), F.abs(right["budget"])) * 0.01,
        "code": left["code"] == right["code"],
        "date": F.abs(F.datediff(left["date"], right["date"])) <= 3,
        "programme": left["programme"] == right["programme"],
    }
    agree = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in fields.items()]))
    return pairs.withColumn("agreements", agree).withColumn(
        "relation", F.when(F.size("agreements") >= minimum, "STRONG_COMPOSITE_MATCH").when(F.size("agreements") > 0, "POSSIBLY_RELATED").otherwise("UNRELATED")
    )


def document_preview(tenders: DataFrame, attachments: DataFrame, docs: DataFrame, key: str, sample: int = 420) -> DataFrame:
    """Latest attachments of tenders with kind, label and a text sample."""
    from deltion.functions.text import short_sample
    from deltion.operators.filters import preview_kind, preview_label

    joined = tenders.join(attachments_with_documents(attachments, docs), key)
    kind = preview_kind(F.col("document_type"), F.col("name"))
    return joined.withColumn("kind", kind).withColumn("kind_label", preview_label(F.col("kind"))).withColumn("sample", short_sample(F.col("text"), sample, ellipsis=True)).drop("text")


def linked_ids_of(docs: DataFrame, key: str, ids: str) -> DataFrame:
    """Distinct linked ids of a row's documents, one per line (`count` alone: aggregate it)."""
    return docs.select(key, F.explode(ids).alias("linked_id")).distinct()
