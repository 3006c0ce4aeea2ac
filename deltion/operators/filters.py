"""Projections, filters and predicates (C*), and the in-row taxonomy labels.

Every function is a Column or a narrow DataFrame transformation: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion import vocab
from deltion.functions.dates import deadline_instant
from deltion.functions.extract import official_url
from deltion.functions.numbers import format_budget
from deltion.functions.text import (
    alias_match,
    any_alias,
    any_term,
    clean,
    focus_term,
    fold_term,
    fold_terms,
    haystack,
    let,
    lines,
    matched_terms,
    norm_text,
    snippet,
    tokens,
    unnest,
    upper_plain,
    upper_term,
)
from deltion.functions.wording import Wording, first_value
from deltion.rules import Scope, UserProfile

STRINGS = "array<string>"


def _no_strings() -> Column:
    return F.array().cast(STRINGS)


def scope_match(text: Column, scopes: Sequence[Scope]) -> Column:
    """C4: array<struct<scope, note>> of the scopes a text names.

    An ambiguous alias is ignored when a negative context is present, confirmed by a positive
    one, and otherwise kept with a note; the first alias that decides wins.
    """
    return let(norm_text(text), lambda folded: let(tokens(folded), lambda toks: _scopes_in(folded, toks, scopes)))


def _scopes_in(folded: Column, toks: Column, scopes: Sequence[Scope]) -> Column:
    out = []
    for scope in scopes:
        def hit(note: Column, scope=scope) -> Column:
            return F.struct(F.lit(scope.name).alias("scope"), note.alias("note"))

        found = F.when(any_alias(folded, toks, scope.aliases), hit(F.lit("")))
        for rule in scope.ambiguous:
            usable = alias_match(folded, toks, rule.alias) & ~any_alias(folded, toks, rule.negative_context)
            note = F.when(
                any_alias(folded, toks, rule.positive_context),
                F.lit(f"ambiguous alias confirmed by context: {fold_term(rule.alias)}"),
            ).otherwise(F.lit(f"ambiguous alias retained for review: {fold_term(rule.alias)}"))
            found = found.when(usable, hit(note))
        out.append(found)
    return F.array_compact(F.array(*out))


def focus_location(text: Column, municipalities: Sequence[Scope], regions: Sequence[Scope]) -> Column:
    """The first place of interest a text names, as the reason shown; null when none."""
    return let(norm_text(text), lambda folded: _place_in(folded, municipalities, regions))


def _place_in(folded: Column, municipalities: Sequence[Scope], regions: Sequence[Scope]) -> Column:
    def named(terms) -> Column:
        test = F.lit(False)
        for term in terms:
            test = test | focus_term(folded, term)
        return test

    reasons = []
    for town in municipalities:
        reason = F.when(named([town.name, *town.aliases]), F.lit(town.name))
        for rule in town.ambiguous:
            usable = focus_term(folded, rule.alias) & ~named(rule.negative_context)
            note = F.when(named(rule.positive_context), F.lit(town.name)).otherwise(
                F.lit(f"{town.name} (ασαφές τοπωνύμιο: {rule.alias})")
            )
            reason = reason.when(usable, note)
        reasons.append(reason)
    for area in regions:
        label = f"{area.name} - {', '.join(area.units)}" if area.units else area.name
        reasons.append(F.when(named(area.units or [area.name, *area.nuts]), F.lit(label)))
    return F.coalesce(*reasons)


def works_gate(folded: Column, source: Column, record_type: Column, has_attachment: Column,
               works=vocab.PUBLIC_WORKS, tender=vocab.TENDER, admin=vocab.ADMIN_DROP, supply=vocab.SUPPLY_DROP,
               general=vocab.NOT_INFRASTRUCTURE, trusted: str = "ESHIDIS") -> Column:
    """Whether a candidate is a public-works tender, with the terms that decided it."""
    return let(folded, lambda f: _gate(f, source, record_type, has_attachment, works, tender, admin, supply, general, trusted))


def _gate(folded: Column, source: Column, record_type: Column, has_attachment: Column, works, tender, admin, supply, general, trusted) -> Column:
    works_hits = matched_terms(folded, fold_terms(works))
    tender_hits = matched_terms(folded, fold_terms(tender))
    admin_hits = matched_terms(folded, fold_terms(admin))
    supply_hits = matched_terms(folded, fold_terms(supply))
    strong = fold_terms(t for t in works if t not in general)
    has_works, has_tender = any_term(folded, fold_terms(works)), any_term(folded, fold_terms(tender))
    infrastructure = any_term(folded, strong)
    decisions = [
        (source == trusted, "KEEP_PUBLIC_WORKS_TENDER", True, "Official public works active-search row.", None),
        (any_term(folded, fold_terms(admin)) & ~has_tender, "DROP_ADMIN", False,
         "Administrative or decision/news row without tender wording.", admin_hits),
        (any_term(folded, fold_terms(supply)) & ~infrastructure, "DROP_OUT_OF_SCOPE_SUPPLY_SERVICE", False,
         "Supply/service procurement without public-works infrastructure signal.", supply_hits),
        (has_works & (has_tender | (record_type == "PROC") | has_attachment), "KEEP_PUBLIC_WORKS_CANDIDATE", True,
         "Public-works terms combined with tender/procurement/document evidence.", None),
        (has_works, "REVIEW_PUBLIC_WORKS_SIGNAL", True, "Public-works terms found, but tender evidence is incomplete.", None),
        (F.lit(True), "DROP_NOT_PUBLIC_WORKS", False, "No public-works signal in title/source metadata.", None),
    ]
    chain = F
    for test, decision, keep, reason, drop in decisions:
        chain = chain.when(
            test,
            F.struct(
                F.lit(decision).alias("decision"), F.lit(keep).alias("keep"), F.lit(reason).alias("reason"),
                (drop if drop is not None else _no_strings()).alias("drop_terms"),
            ),
        )
    return F.struct(
        chain["decision"].alias("decision"), chain["keep"].alias("keep"), chain["reason"].alias("reason"),
        works_hits.alias("works_terms"), tender_hits.alias("tender_terms"), chain["drop_terms"].alias("drop_terms"),
    )


def notice_status(record_type: Column, cancelled: Column, deadline: Column, as_of: Column) -> Column:
    """Submission status of a feed notice on a day."""
    day = deadline.try_cast("timestamp").cast("date")
    return (
        F.when(record_type == "AWRD", "HISTORICAL_AWARD_RECORD")
        .when(record_type == "SYMV", "HISTORICAL_CONTRACT_RECORD")
        .when(F.coalesce(cancelled, F.lit(False)), "CANCELLED_NOTICE")
        .when(day.isNull(), "UNKNOWN_DEADLINE_CANDIDATE")
        .when(day > as_of, "SUBMISSION_OPEN_CANDIDATE")
        .otherwise("SUBMISSION_EXPIRED_CANDIDATE")
    )


def classify_name(name: Column, rules=vocab.DOCUMENT_RULES) -> Column:
    """struct<document_type, confidence, matched>: first rule with a term in the file name."""
    return let(norm_text(name, underscores=True), lambda folded: _document_type(folded, rules))


def _document_type(folded: Column, rules) -> Column:
    chain = F
    for kind, terms in rules:
        plain = fold_terms(terms, underscores=True)
        chain = chain.when(
            any_term(folded, plain),
            F.struct(F.lit(kind).alias("document_type"), F.lit(0.95).alias("confidence"), matched_terms(folded, plain, terms).alias("matched")),
        )
    return chain.otherwise(
        F.struct(F.lit("other").alias("document_type"), F.lit(0.2).alias("confidence"), _no_strings().alias("matched"))
    )


def status_signals(df: DataFrame, tender: str, name: str, document_type: str, text: str,
                   patterns=vocab.ACT_PATTERNS, phrases=vocab.PROCEDURAL_PHRASES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sign that a procedure has moved on: document type, file name, or a
    (not decisive) mention in a declaration's text."""
    folded = norm_text(F.col(name))
    kinds = [kind for kind, _ in patterns]

    def signal(kind, source: str, evidence: Column, decisive: bool) -> Column:
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        return F.struct(
            kind.alias("signal_type"), F.lit(source).alias("signal_source"), evidence.alias("evidence"), F.lit(decisive).alias("decisive")
        )

    kind = F.col(document_type)
    found = [F.when(kind.isin(kinds), signal(kind, "document_type", F.concat(F.lit("document_type="), kind), True))]
    for act, terms in patterns:
        plain = fold_terms(terms)
        matched = F.array_join(matched_terms(folded, plain, terms), ", ")
        found.append(F.when(any_term(folded, plain), signal(act, "attachment_filename", matched, True)))
    for phrase in phrases:
        pos = F.instr(F.col(text), F.lit(phrase))
        mention = signal("procedural_mention", "tender_declaration_text_sample", snippet(F.col(text), pos, 140, 140), False)
        found.append(F.when((kind == "tender_declaration") & (pos > 0), mention))
    columns = [tender, *keep, name]
    return unnest(df, columns, F.array_compact(F.array(*found)), "_s").select(*columns, "_s.*")


def recommend_status(tenders: DataFrame, signals: DataFrame, key: str, deadline: str, now: Column) -> DataFrame:
    """Recommended status of each tender with its rationale; never a verified one."""
    decisive = signals.groupBy(key).agg(F.bool_or("decisive").alias("_decisive"), F.count(F.lit(1)).alias("signal_count"))
    moved = F.coalesce("_decisive", F.lit(False))
    at = deadline_instant(F.col(deadline))
    status = F.when(moved, "UNKNOWN").when(at > now, "POSSIBLY_ACTIVE").when(at <= now, "SUBMISSION_EXPIRED").otherwise("UNKNOWN")
    confidence = F.when(moved, 0.35).when(at > now, 0.65).when(at <= now, 0.70).otherwise(0.0)
    rationale = (
        F.when(moved, F.array(F.lit("status-changing act among the latest file names; manual review required")))
        .when(at > now, F.array(F.lit("official deadline is in the future"), F.lit("no decisive act among the latest attachments"),
                                F.lit("no separate status source, so not verified")))
        .when(at <= now, F.array(F.lit("official deadline has passed")))
        .otherwise(F.array(F.lit("no parseable official deadline")))
    )
    return (
        tenders.join(decisive, key, "left")
        .withColumn("recommended_status", status)
        .withColumn("status_confidence", confidence)
        .withColumn("rationale", rationale)
        .withColumn("signal_count", F.coalesce("signal_count", F.lit(0)))
        .drop("_decisive")
    )


def effective_deadline(own: Column, linked: Column, evidence: Column) -> Column:
    """C11: own deadline, else the latest of linked official rows, else the one found in documents."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(linked, F.lit("")), F.nullif(evidence, F.lit("")))


def is_active(deadline: Column, as_of: Column) -> Column:
    """C11: still open on a day; rows without a deadline are not."""
    return F.coalesce(F.to_date(F.from_utc_timestamp(deadline_instant(deadline), "Europe/Athens")) >= as_of, F.lit(False))


def user_profile_match(folded: Column, labels: Column, budget: Column, profile: UserProfile) -> Column:
    """struct<active, matches, reasons> of a row for a user profile.

    `labels` are the row's category labels (E21); budgets are ignored where the row has none.
    """
    if not profile.active:
        return F.struct(F.lit(False).alias("active"), F.lit(True).alias("matches"), _no_strings().alias("reasons"))
    reasons, tests = [], []

    def named(label: str, found: Column) -> Column:
        return F.concat(F.lit(label), F.array_join(F.slice(found, 1, 4), ", "))

    if profile.include:
        found = matched_terms(folded, fold_terms(profile.include), profile.include)
        tests.append(F.size(found) > 0)
        reasons.append(F.when(F.size(found) > 0, named("λέξεις ενδιαφέροντος: ", found)).otherwise("δεν βρέθηκε λέξη ενδιαφέροντος"))
    if profile.exclude:
        found = matched_terms(folded, fold_terms(profile.exclude), profile.exclude)
        tests.append(F.size(found) == 0)
        reasons.append(F.when(F.size(found) > 0, named("αποκλείστηκε από: ", found)))
    if profile.category_ids:
        wanted = F.filter(labels, lambda x: (x["polarity"] == "positive") & x["id"].isin(list(profile.category_ids)))
        tests.append(F.size(wanted) > 0)
        reasons.append(
            F.when(F.size(wanted) > 0, named("κατηγορίες έργων: ", F.transform(wanted, lambda x: x["label"]))).otherwise(
                "δεν ταιριάζει στις επιλεγμένες κατηγορίες έργων"
            )
        )
    if profile.min_budget is not None or profile.max_budget is not None:
        reasons.append(F.when(budget.isNull(), "δεν υπάρχει καθαρός προϋπολογισμός για εφαρμογή ορίου"))
    for bound, below, low_word, high_word in (
        (profile.min_budget, True, "κάτω από ελάχιστο budget ", "πάνω από ελάχιστο budget "),
        (profile.max_budget, False, "κάτω από μέγιστο budget ", "πάνω από μέγιστο budget "),
    ):
        if bound is None:
            continue
        shown = format_budget(F.lit(bound))
        fails = budget < F.lit(bound) if below else budget > F.lit(bound)
        bad, good = (low_word, high_word) if below else (high_word, low_word)
        tests.append(F.coalesce(~fails, F.lit(True)))
        reasons.append(F.when(fails, F.concat(F.lit(bad), shown)).when(budget.isNotNull(), F.concat(F.lit(good), shown)))
    matches = F.lit(True)
    for test in tests:
        matches = matches & test
    listed = F.array_compact(F.array(*reasons))
    nothing = F.array(F.lit("προσωπικό προφίλ χωρίς περιορισμούς που επηρεάζουν αυτό το έργο"))
    return F.struct(
        F.lit(True).alias("active"), matches.alias("matches"), F.when(F.size(listed) > 0, listed).otherwise(nothing).alias("reasons")
    )


def confidence_band(keep: Column, confidence: Column) -> Column:
    """Band of a label by keep/drop and confidence."""
    return (
        F.when(confidence.isNull(), "UNREVIEWED")
        .when(keep & (confidence >= 0.9), "SURE_MATCH")
        .when(keep & (confidence >= 0.75), "LIKELY_MATCH")
        .when(keep, "NEEDS_REVIEW")
        .when(confidence >= 0.9, "SURE_DROP")
        .when(confidence >= 0.75, "LIKELY_DROP")
        .otherwise("NEEDS_REVIEW")
    )


def open_notice_filter(df: DataFrame) -> DataFrame:
    """Open feed notices that can be fetched."""
    return df.filter(
        (F.col("source") == "KIMDIS") & (F.col("record_type") == "PROC") & (F.col("status") == "SUBMISSION_OPEN_CANDIDATE")
        & (F.col("official_id") != "") & (F.col("attachment_url") != "")
    )


def is_landing(title: Column, url: Column, suffixes=("/erga-drasis",), titles=("εργα & δρασεις", "εργα και δρασεις")) -> Column:
    """Navigation row rather than a notice."""
    plain = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "/+$", "")
    test = norm_text(F.coalesce(title, F.lit(""))).isin(fold_terms(titles))
    for suffix in suffixes:
        test = test | plain.endswith(suffix)
    return test


def drop_landing_rows(df: DataFrame, title: str, url: str, **kw) -> DataFrame:
    """C16."""
    return df.filter(~is_landing(F.col(title), F.col(url), **kw))


def needs_ocr(status: Column, text: Column, minimum: int = 80) -> Column:
    """C17: the text layer is missing or too short."""
    bad = status.isin("EXTRACTION_FAILED", "NO_TEXT_FOUND", "NO_TEXT_EXTRACTOR")
    return F.coalesce(bad, F.lit(False)) | (F.length(clean(F.coalesce(text, F.lit("")))) < minimum)


def skip_analysis(status: Column, text: Column) -> Column:
    """C17: already analysed: there is text, or a final status."""
    final = F.upper(status).isin("NO_TEXT_FOUND", "UNSUPPORTED_TYPE", "UNSUPPORTED_FILE_TYPE", "TEXT_EXTRACTION_UNSUPPORTED")
    return (F.length(F.coalesce(text, F.lit(""))) > 0) | F.coalesce(final, F.lit(False))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    chain = F
    for name, value in table.items():
        chain = chain.when(key == name, value)
    return chain.otherwise(default)


def hidden_category(decision: Column) -> Column:
    """C18."""
    return _lookup(decision, vocab.HIDDEN_CATEGORY, "AI_HIDDEN")


def hidden_reason(decision: Column, reason: Column) -> Column:
    """The text shown for a row hidden by its label."""
    label = _lookup(decision, vocab.HIDDEN_LABEL, "μη κατάλληλο για την καθημερινή λίστα")
    given = F.trim(F.coalesce(reason, F.lit("")))
    return F.concat(F.lit("AI έλεγχος: "), label, F.when(given != "", F.concat(F.lit(". "), given)).otherwise("."))


def out_of_scope_reason(title: Column, display_id: Column, groups=vocab.OUT_OF_SCOPE, road=vocab.REVIEW_ROAD,
                        maintenance=vocab.REVIEW_MAINTENANCE, tender=vocab.REVIEW_TENDER) -> Column:
    """C20: why a title is plainly no public work; null for road maintenance tenders and others."""
    return let(haystack(title, display_id), lambda folded: _plain_reason(folded, groups, road, maintenance, tender))


def _plain_reason(folded: Column, groups, road, maintenance, tender) -> Column:
    guard = any_term(folded, fold_terms(road)) & any_term(folded, fold_terms(maintenance)) & any_term(folded, fold_terms(tender))
    chain = F.when(guard, F.lit(None).cast("string"))
    for label, terms in groups:
        chain = chain.when(any_term(folded, fold_terms(terms)), F.lit(f"Κρύφτηκε επειδή ο τίτλος δείχνει καθαρά {label}."))
    return chain


def review_priority(category: Column, decision: Column, confidence: Column, title: Column, reason: Column, out_of_scope: Column,
                    confirmed_drop: Column, works=vocab.REVIEW_WORKS_SIGNAL, tender=vocab.REVIEW_TENDER_SIGNAL) -> Column:
    """HIGH / MEDIUM / LOW for hidden rows worth a second look; null for the others."""
    works_signal = any_term(haystack(title, reason), fold_terms(works))
    tender_signal = any_term(norm_text(F.coalesce(title, F.lit(""))), fold_terms(tender))
    none = F.lit(None).cast("string")
    dropped = category.startswith("AI_DROP")
    out = out_of_scope.isNotNull()
    unsure_works = works_signal & decision.isin("DROP_OUT_OF_SCOPE_SUPPLY_SERVICE", "DROP_NOT_PUBLIC_WORKS")
    return (
        F.when(F.coalesce(confirmed_drop, F.lit(False)) | (category == "OUT_OF_SCOPE_SUPPLY_SERVICE"), none)
        .when(category == "NO_DEADLINE_EVIDENCE", F.when(out, none).when(tender_signal, "HIGH").otherwise("MEDIUM"))
        .when(category == "DUPLICATE_CANDIDATE", "MEDIUM")
        .when(dropped & (confidence.isNull() | (confidence < 0.9)), "HIGH")
        .when(dropped & unsure_works, F.when(out, none).otherwise("HIGH"))
        .when(category.isin("AI_DROP_SUPPLY_SERVICE", "AI_DROP_NOT_PUBLIC_WORKS"), "MEDIUM")
        .when(dropped, "LOW")
    )


def triage_guard(decision: Column, confidence: Column, reason: Column, hints: Column, row_text: Column, deadline: Column, budget: Column,
                 road=vocab.ROAD, maintenance=vocab.ROAD_MAINTENANCE, tender=vocab.ROAD_TENDER, excluded=vocab.ROAD_EXCLUDED) -> Column:
    """A label made valid: struct<decision, confidence, reason, hints, keep>.

    Unknown labels become review; a dropped road-maintenance tender with deadline and budget goes
    back to review with confidence capped at .74; dropped rows lose their id hints.
    """
    valid = F.when(decision.isin(vocab.DECISIONS), decision).otherwise("REVIEW_TENDER_CANDIDATE")
    number = F.coalesce(confidence, F.lit(0.0))
    has = lambda c: F.length(F.trim(F.coalesce(c.cast("string"), F.lit("")))) > 0
    road_works = let(haystack(row_text, reason), lambda folded: (
        ~any_term(folded, fold_terms(excluded))
        & any_term(folded, fold_terms(road)) & any_term(folded, fold_terms(maintenance)) & any_term(folded, fold_terms(tender))
        & (has(budget) | folded.rlike(r"\d[\d.]*,\d{2}\s*(?:€|eur)"))
    ))
    guard = (valid == "DROP_OUT_OF_SCOPE_SUPPLY_SERVICE") & has(deadline) & road_works
    final = F.when(guard, "REVIEW_TENDER_CANDIDATE").otherwise(valid)
    keep = final.isin(vocab.KEEP_DECISIONS)
    note = (
        "Programmatic guard: συντήρηση οδικού/επαρχιακού δικτύου με διαγωνιστική ένδειξη κρατιέται για έλεγχο δημοσίων έργων. "
    )
    ids = F.array_distinct(F.filter(F.coalesce(hints, _no_strings()), lambda x: x.rlike(r"^\d{5,6}$")))
    return F.struct(
        final.alias("decision"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(guard, F.least(number, F.lit(0.74))).otherwise(number))).alias("confidence"),
        F.when(guard, F.trim(F.concat(F.lit(note), F.coalesce(reason, F.lit(""))))).otherwise(F.coalesce(reason, F.lit(""))).alias("reason"),
        F.when(keep, ids).otherwise(_no_strings()).alias("hints"),
        keep.alias("keep"),
    )


# File-name wording of pricing documents.
ESSENTIAL = ["ΠΡΟΣΚΛΗΣ", "ΔΙΑΚΗΡΥΞ", "ΔΙΑΚΗΡ", "ΤΕΧΝΙΚΗ ΕΚΘΕΣ", "ΤΕΧΝΙΚΗ ΠΕΡΙΓΡΑΦ", "ΠΡΟΥΠΟΛΟΓ"]
DRAWING = ["ΣΧΕΔ", "DRAWING", "ΚΑΤΟΨ", "ΤΟΜΗ", "ΟΨΗ", "ΟΠΛΙΣΜ", "ΛΕΠΤΟΜΕΡ", "ΑΡΧΙΤΕΚΤΟΝΙΚ", "LAYOUT"]
OTHER_STUDY = [
    "ΣΤΑΤΙΚΗ", "Η/Μ", "ΗΛΕΚΤΡΟΜΗΧΑΝΟΛ", "ΠΥΡΑΣΦΑΛ", "ΚΛΙΜΑΤΙΣΜ", "FAN COIL", "FAN_COIL", "ΓΕΩΛΟΓ", "ΓΕΩΤΕΧΝ", "ΠΕΡΙΒΑΛ",
    "ΦΥΤΟΤΕΧΝ", "ΣΑΥ", "ΦΑΥ", "ΑΔΕΙΑ", "ΔΙΟΙΚΗΤ",
]
OFFER = ("ΟΙΚΟΝΟΜΙΚ", "ΠΡΟΣΦΟΡ")
BUDGET = ("ΠΡΟΥΠΟΛΟΓ",)
PRICING_STRONG = ("ΠΡΟΥΠΟΛΟΓ", "ΤΙΜΟΛΟΓ", "ΠΡΟΜΕΤΡ", "ΑΝΑΛΥΤΙΚ")
PRICING_BROAD = ("ΤΕΧΝΙΚΗΕΚΘΕΣΗ", "ΤΕΧΝΙΚΗ_ΕΚΘΕΣΗ", "ΜΕΛΕΤΗ")
IS_DRAWING = Wording(False, any=(*DRAWING, *OTHER_STUDY), not_squeezed=BUDGET)
# How surely a stand-alone file is the official budget; the first that holds counts.
BUDGET_PRIORITY = [
    Wording(0, all=OFFER), Wording(90, squeezed=BUDGET, all=("ΠΡΟΜΕΤΡΗΣ",)), Wording(80, squeezed=BUDGET), Wording(45, all=("ΠΡΟΜΕΤΡΗΣ",)),
    Wording(20, pattern="(^|[^A-ZΑ-Ω0-9])(ΠΥ|ΠY|PY)($|[^A-ZΑ-Ω0-9])"),
]
PRESERVE = [IS_DRAWING, Wording(False, all=OFFER), Wording(True, any=tuple(ESSENTIAL))]
# Whether a file is worth reading for prices by its own name (2: by that of its folder).
PRICING_NAME = [Wording(0, any=IS_DRAWING.any, not_squeezed=BUDGET), Wording(1, all=OFFER), Wording(1, squeezed=PRICING_STRONG)]


def _named(name: Column, document_type: Column) -> Column:
    return upper_plain(F.concat_ws(" ", name, F.coalesce(document_type, F.lit(""))))


def budget_priority(name: Column, document_type: Column) -> Column:
    """0/20/45/80/90: how surely a stand-alone file is the official budget."""
    inside = F.translate(name, "\\", "/").contains("/")
    return F.when(inside, 0).otherwise(let(_named(name, document_type), lambda upper: first_value(upper, BUDGET_PRIORITY, 0)))


def preserve_document(name: Column, document_type: Column) -> Column:
    """Keep the file until the deadline."""
    archive = F.lower(name).rlike(r"\.(zip|rar|7z)$") | (F.lower(F.coalesce(document_type, F.lit(""))) == "archive")
    return ~archive & let(_named(name, document_type), lambda upper: first_value(upper, PRESERVE, False))


def pricing_candidate(name: Column) -> Column:
    """Worth reading for priced lines. A file in a folder may have it from the folder's name."""
    path = F.translate(name, "\\", "/")
    folder = upper_plain(F.regexp_extract(path, "^(.*)/[^/]*$", 1))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    by_folder = let(folder, lambda upper: first_value(upper, [Wording(True, squeezed=PRICING_STRONG)], False))

    def by_name(leaf: Column) -> Column:
        broad = F.when(path.contains("/"), by_folder).otherwise(first_value(leaf, [Wording(True, squeezed=PRICING_BROAD)], False))
        return let(first_value(leaf, PRICING_NAME, 2), lambda told: F.when(told < 2, told == 1).otherwise(broad))

    signal = let(upper_plain(F.substring_index(path, "/", -1)), by_name)
    return F.when(suffix.isin(".txt", ".text"), F.lit(True)).when(suffix != ".pdf", F.lit(False)).otherwise(signal)


# Phrases that head a budget table.
BUDGET_PHRASES = [
    "ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ ΜΕΛΕΤΗΣ", "ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ ΕΡΓΑΣΙΩΝ", "ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ ΕΡΓΟΥ", "ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ ΚΑΤΑΣΚΕΥΗΣ",
    "ΑΝΑΛΥΤΙΚΟΣ ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ", "ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ ΔΗΜΟΠΡΑΤΗΣΗΣ",
]


def contains_budget(text: Column) -> Column:
    """The text holds a budget table."""

    def test(upper: Column) -> Column:
        columns = upper.contains("ΤΙΜΗ ΜΟΝΑΔΑΣ") & upper.contains("ΠΟΣΟΤΗΤΑ") & upper.contains("ΔΑΠΑΝΗ")
        return upper.contains("ΠΡΟΥΠΟΛΟΓΙΣ") & (any_term(upper, [upper_term(p) for p in BUDGET_PHRASES]) | columns)

    return let(upper_plain(text), test)


def partial_budget(text: Column) -> Column:
    """Numbering that starts after 1 with at most ten rows: pages are missing."""
    numbers = F.array_distinct(
        F.filter(F.transform(lines(text), lambda x: F.regexp_extract(x, r"^\s*(\d{1,9})\s", 1).try_cast("int")), lambda n: n.isNotNull())
    )
    few = let(numbers, lambda n: (F.size(n) > 0) & (F.array_min(n) > 1) & (F.size(n) <= 10))
    return F.coalesce(upper_plain(text).contains("ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ") & few, F.lit(False))


def is_document_url(url: Column, extensions=vocab.DOCUMENT_EXTENSIONS) -> Column:
    """The path ends with a document extension (query ignored)."""
    return F.substring_index(F.lower(url), "?", 1).rlike(rf"\.({'|'.join(extensions)})$")


NOTICE_ID = r"^\d{2}PROC\d{9}$"


def row_key(source: Column, official_id: Column, is_registry_id: Column) -> Column:
    """Key of a row: feed notices and authority pages get a prefix, registry ids stand alone."""
    return (
        F.when((source == "KIMDIS") | official_id.rlike(NOTICE_ID), F.concat(F.lit("KIMDIS:"), official_id))
        .when((source == "ESHIDIS") | is_registry_id, official_id)
        .otherwise(F.concat(F.lit("AUTHORITY:"), official_id))
    )


def registry_numeric_id(official_id: Column, record_type: Column, text: Column) -> Column:
    """A six-digit authority id that the row's text shows to be a registry id."""
    folded = norm_text(F.coalesce(text, F.lit("")))
    own = any_term(folded, ["εσηδησ", "ε.σ.η.δη.σ", "ε σ η δ η σ", "pwgopendata eprocurement gov gr", "actsearchergwn"])
    foreign = any_term(folded, ["ted europa eu", "ted.europa.eu"])
    foreign = foreign & ~any_term(folded, ["εσηδησ", "ε.σ.η.δη.σ", "actsearchergwn"])
    return official_id.rlike(r"^\d{6}$") & ~foreign & ((F.lower(record_type) == "eshidis") | own)


def official_status(registry_id: Column, linked_ids: Column) -> Column:
    return (
        F.when(F.coalesce(registry_id, F.lit("")) != "", "OFFICIAL_ESHIDIS")
        .when(F.size(linked_ids) > 0, "LINKED_TO_ESHIDIS")
        .otherwise("CANDIDATE_NO_ESHIDIS_ID")
    )


def official_status_label(status: Column) -> Column:
    """C25."""
    labels = {
        "OFFICIAL_ESHIDIS": "Επίσημο ΕΣΗΔΗΣ",
        "LINKED_TO_ESHIDIS": "Σύνδεση με ΕΣΗΔΗΣ",
        "CANDIDATE_NO_ESHIDIS_ID": "Δεν βρέθηκε ακόμα ΕΣΗΔΗΣ",
    }
    chain = F
    for name, value in labels.items():
        chain = chain.when(status == name, value)
    return chain.otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit("Άγνωστο")))


def page_flags(body: Column) -> Column:
    """Struct of signs that a page needs a browser."""
    low = F.lower(body)
    browser = any_term(low, ["requires a javascript enabled browser", "adfloopbackutils", "captcha", "__next_data__"])
    return F.struct(
        browser.alias("requires_browser"),
        body.contains("requires a JavaScript enabled browser").alias("needs_javascript"),
        body.contains("AdfLoopbackUtils.runLoopback").alias("loopback"),
        body.contains("jsessionid=").alias("session_hint"),
    )


def document_evidence(text: Column, authority: Column, scopes: Sequence[Scope], row_scopes: Column) -> Column:
    """struct<status, authority_match, scopes>: does the text name the authority or a scope of the row."""
    return let(norm_text(text), lambda folded: let(tokens(folded), lambda toks: _names_in(folded, toks, text, authority, scopes, row_scopes)))


def _names_in(folded: Column, toks: Column, text: Column, authority: Column, scopes: Sequence[Scope], row_scopes: Column) -> Column:
    named = F.coalesce((norm_text(authority) != "") & (F.instr(folded, norm_text(authority)) > 0), F.lit(False))
    found = F.array_compact(
        F.array(*[F.when(F.array_contains(row_scopes, s.name) & any_alias(folded, toks, [s.name, *s.aliases]), F.lit(s.name)) for s in scopes])
    )
    status = (
        F.when(F.length(F.coalesce(text, F.lit(""))) == 0, "NO_TEXT_FOR_EVIDENCE_CHECK")
        .when(named | (F.size(found) > 0), "DOCUMENT_EVIDENCE_FOUND")
        .otherwise("DOCUMENT_TEXT_EXTRACTED_NO_SCOPE_AUTHORITY_MATCH")
    )
    return F.struct(status.alias("status"), F.when(named, authority).alias("authority_match"), found.alias("scopes"))


def triage_features(text: Column, official_id: Column, attachment_count: Column, evidence: Column | None = None,
                    works=vocab.PUBLIC_WORKS, admin=vocab.ADMIN_DROP, supply=vocab.SUPPLY_DROP) -> Column:
    """Input of a labelling step: flags, term signals, a 1 200 character sample, and at most
    four documents with five snippets each."""
    return let(norm_text(text), lambda folded: _features(folded, text, official_id, attachment_count, evidence, works, admin, supply))


def _features(folded: Column, text: Column, official_id: Column, attachment_count: Column, evidence: Column | None, works, admin, supply) -> Column:
    fields = [
        (F.coalesce(official_id.rlike(r"\b\d{5,7}\b"), F.lit(False)) | any_term(folded, ["eshidis", "εσηδησ"])).alias("has_registry_id"),
        (F.coalesce(F.lower(official_id).rlike(r"\b\d{2}proc\d{9}\b"), F.lit(False)) | folded.rlike(r"\b\d{2}proc\d{9}\b")).alias("has_notice_id"),
        ((attachment_count > 0) | any_term(folded, [".pdf", ".zip"])).alias("has_documents"),
        matched_terms(folded, fold_terms(works)).alias("works_terms"),
        matched_terms(folded, fold_terms(admin)).alias("admin_terms"),
        matched_terms(folded, fold_terms(supply)).alias("supply_terms"),
        F.substring(text, 1, 1200).alias("text_sample"),
    ]
    if evidence is not None:
        trimmed = F.transform(
            F.slice(evidence, 1, 4),
            lambda d: F.struct(
                d["name"].alias("name"),
                F.slice(F.transform(F.filter(d["snippets"], lambda s: F.length(F.trim(s)) > 0), lambda s: F.substring(s, 1, 1200)), 1, 5).alias("snippets"),
            ),
        )
        fields.append(trimmed.alias("document_evidence"))
    return F.struct(*fields)


PREVIEW_LABEL = {
    "declaration": "Διακήρυξη", "technical_description": "Τεχνική περιγραφή", "budget": "Προϋπολογισμός", "price_list": "Τιμολόγιο",
}


def preview_kind(document_type: Column, name: Column) -> Column:
    """Kind of a document from its type or name."""
    kind = F.coalesce(document_type, F.lit(""))
    return let(haystack(document_type, name), lambda folded: _kind_of(folded, kind))


def _kind_of(folded: Column, kind: Column) -> Column:
    return (
        F.when((kind == "tender_declaration") | folded.contains("διακηρυ"), "declaration")
        .when((kind == "technical_description") | folded.contains("τεχνικη περιγραφ"), "technical_description")
        .when((kind == "budget") | folded.contains("προυπολογισ"), "budget")
        .when((kind == "price_list") | folded.contains("τιμολογιο"), "price_list")
        .otherwise("other")
    )


def preview_label(kind: Column) -> Column:
    return _lookup(kind, PREVIEW_LABEL, "Λοιπό αρχείο")


def reason_pick(reasons: Column, fallback: Column, skip=("Πηγή", "Έγγραφα")) -> Column:
    """First explanation (struct<label, text>) that is not about source or documents."""
    useful = F.filter(reasons, lambda r: (F.length(F.trim(r["text"])) > 0) & ~r["label"].isin(list(skip)))
    return F.coalesce(F.try_element_at(useful, F.lit(1))["text"], F.trim(fallback))


def taxonomy_labels(text: Column, cpv: Column, taxonomy=vocab.TAXONOMY) -> Column:
    """array<struct> of the categories a row shows signals of.

    Score = 2 per code prefix and strong term, 1 per medium term;
    confidence = min(.99, score / max(3, 2 weight)).
    """
    return let(norm_text(text), lambda folded: _labels_in(folded, cpv, taxonomy))


def _labels_in(folded: Column, cpv: Column, taxonomy) -> Column:
    out = []
    for cat in taxonomy:
        cpv_hits = matched_terms(cpv, cat["cpv"])
        strong = matched_terms(folded, fold_terms(cat["strong"]), cat["strong"])
        medium = matched_terms(folded, fold_terms(cat["medium"]), cat["medium"])
        out.append(let(F.struct(cpv_hits.alias("cpv"), strong.alias("strong"), medium.alias("medium")), lambda hits, cat=cat: _label_of(hits, cat)))
    return F.array_sort(F.array_compact(F.array(*out)))


def _label_of(hits: Column, cat: dict) -> Column:
    """The label of one category from its hits, or null without any. Every term has been searched once."""
    score = 2 * F.size(hits["cpv"]) + 2 * F.size(hits["strong"]) + F.size(hits["medium"])
    confidence = F.round(F.least(F.lit(0.99), score / F.lit(max(3.0, cat["weight"] * 2.0))), 2)
    return F.when(score > 0, F.struct(
        F.when(F.lit(cat["polarity"] == "positive"), 0).otherwise(1).alias("rank"), (-confidence).alias("neg_confidence"), F.lit(cat["label"]).alias("label"), F.lit(cat["id"]).alias("id"),
        F.lit(cat["polarity"]).alias("polarity"), confidence.alias("confidence"), F.concat(hits["cpv"], hits["strong"], hits["medium"]).alias("evidence"),
    ))


def taxonomy_audit(labels: Column, strong: float = 0.85, likely: float = 0.6) -> Column:
    """Primary category, negative ones, review flag and band of the labels of a row.

    Labels come sorted: positive first, then falling confidence, then name.
    """
    return let(labels, lambda found: _audit_of(found, strong, likely))


def _audit_of(labels: Column, strong: float, likely: float) -> Column:
    positive = F.filter(labels, lambda x: x["polarity"] == "positive")
    negative = F.filter(labels, lambda x: x["polarity"] == "negative")
    top = F.coalesce(F.array_max(F.transform(labels, lambda x: x["confidence"])), F.lit(0.0))
    review = (F.size(positive) == 0) | (top < strong) | (F.size(negative) > 0)
    band = (
        F.when(F.size(labels) == 0, "UNKNOWN_REVIEW").when(review, "NEEDS_REVIEW").when(top >= strong, "STRONG")
        .when(top >= likely, "LIKELY").otherwise("NEEDS_REVIEW")
    )
    return F.struct(
        F.try_element_at(labels, F.lit(1))["id"].alias("primary"),
        F.transform(negative, lambda x: x["id"]).alias("negative"),
        F.size(labels).alias("label_count"),
        top.alias("top_confidence"),
        review.alias("needs_review"),
        band.alias("band"),
    )


def decorate(df: DataFrame) -> DataFrame:
    """Display and sort columns of a dashboard row (row_key, registry_id, budget, deadline, linked_ids)."""
    from deltion.functions.dates import display, sort_key

    status = official_status(F.col("registry_id"), F.col("linked_ids"))
    return df.select(
        "*",
        format_budget(F.col("budget")).alias("budget_display"),
        display(F.col("deadline")).alias("deadline_display"),
        sort_key(F.coalesce("deadline", F.lit(""))).alias("deadline_sort"),
        status.alias("official_status"),
        official_status_label(status).alias("official_status_label"),
        F.when(F.col("registry_id").isNotNull(), official_url(F.col("registry_id"))).alias("registry_url"),
    )
