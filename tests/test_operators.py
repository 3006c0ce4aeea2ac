"""Operators on literals, and against brute force where SQL gives no oracle."""

import random
import re

from pyspark.sql import functions as F

from deltion.functions.text import fold_term
from deltion.operators import budget, budget_text, filters, links, monitor, ranking
from deltion.rules import AmbiguousAlias, EvaluationRule, Scope, SearchProfile


def test_classify_and_taxonomy(spark):
    df = spark.createDataFrame([("Συντήρηση επαρχιακού οδικού δικτύου και ασφαλτόστρωση", "45233141-9"), ("Προμήθεια καυσίμων και λιπαντικών", "")], "t string, cpv string")
    rows = df.select(filters.taxonomy_audit(filters.taxonomy_labels(F.col("t"), F.col("cpv"))).alias("a")).collect()
    assert rows[0].a.primary == "road_works" and rows[0].a.top_confidence >= 0.85 and not rows[0].a.needs_review
    assert rows[1].a.negative == ["supply_service_out"] and rows[1].a.band == "NEEDS_REVIEW"


def test_ambiguous_place(spark):
    scope = Scope("Δήμος Δωρίδος", ("Δωρίδα",), (AmbiguousAlias("Γλυφάδα", ("Φωκίδα",), ("Αττική",)),))
    area = Scope("Περιφέρεια Στερεάς Ελλάδας", units=("Φωκίδα",))
    df = spark.createDataFrame([("Έργο στη Φθιώτιδα EL644",), ("έργο Φωκίδας, Φωκίδα EL645",), ("Οδός στη Γλυφάδα",), ("Γλυφάδα Φωκίδα",), ("Γλυφάδα Αττική",)], "t string")
    got = [r.r for r in df.select(filters.focus_location(F.col("t"), [scope], [area]).alias("r")).collect()]
    assert got == [None, "Περιφέρεια Στερεάς Ελλάδας - Φωκίδα", "Δήμος Δωρίδος (ασαφές τοπωνύμιο: Γλυφάδα)", "Δήμος Δωρίδος", None]


def test_rule_with_number(spark):
    rule = EvaluationRule("dig", document_types=("budget",), phrases=("εκσκαφές θεμελίων",), operator=">", threshold=5.0, score=4.0)
    df = spark.createDataFrame([(1, "Εκσκαφές θεμελίων τιμή μονάδας 6,25 ευρώ ανά m3", "budget"), (2, "Εκσκαφές θεμελίων τιμή 4,50 ευρώ", "budget"), (3, "Εκσκαφές θεμελίων 9,00", "other")], "doc_id int, text string, kind string")
    hits = links.evaluate_rules(df, [rule], "text", "kind", ["doc_id"]).collect()
    assert [(h.doc_id, h.score, h.numeric_value) for h in hits] == [(1, 4.0, 6.25)]


def test_status(spark):
    att = spark.createDataFrame([(1, "Κατακύρωση.pdf", "other", ""), (2, "x.pdf", "tender_declaration", "έως την κατακύρωση")], "tender int, name string, kind string, body string")
    signals = filters.status_signals(att, "tender", "name", "kind", "body")
    tenders = spark.createDataFrame([(1, "01-01-2030 10:00"), (2, "01-01-2030 10:00"), (3, "01-01-2020"), (4, "")], "tender int, deadline string")
    out = {r.tender: (r.recommended_status, r.status_confidence) for r in filters.recommend_status(tenders, signals, "tender", "deadline", F.to_timestamp(F.lit("2026-01-01 00:00:00"))).collect()}
    assert out == {1: ("UNKNOWN", 0.35), 2: ("POSSIBLY_ACTIVE", 0.65), 3: ("SUBMISSION_EXPIRED", 0.7), 4: ("UNKNOWN", 0.0)}
    assert "final_award" in {r.signal_type for r in signals.collect()}


def test_source_health(spark):
    runs = spark.createDataFrame([("a", i, "ERROR") for i in range(5)] + [("b", 0, "ERROR"), ("b", 1, "OK"), ("c", 1, "OK")], "source_id string, n int, status string")
    got = {r.source_id: (r.status, r.consecutive_failures) for r in monitor.source_health(runs, "source_id", "n", "n", F.col("status") == "ERROR", 20).collect()}
    assert got == {"a": ("DISABLE_CANDIDATE", 5), "b": ("WATCH", 0), "c": ("HEALTHY", 0)}


def _words(s):
    return set(w for w in fold_term(s, underscores=True).split(" ") if w)


def _greedy(matches):
    kept = []
    for m in matches:
        at = next((i for i, k in enumerate(kept) if k[0] == m[0] and _words(k[3]) and _words(m[3]) and len(_words(k[3]) & _words(m[3])) / min(len(_words(k[3])), len(_words(m[3]))) >= 0.70), None)
        if at is None:
            kept.append(m)
        elif (m[2], len(m[1])) > (kept[at][2], len(kept[at][1])):
            kept[at] = m
    return kept


def test_dedupe_similar_equals_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for d in range(60):
        matches = [(rng.choice("ab"), "t" * rng.randint(1, 6), rng.choice([0.6, 0.9]), " ".join(rng.choice("xyzuvw") for _ in range(rng.randint(1, 6)))) for _ in range(rng.randint(0, 8))]
        docs.append((d, matches))
    df = spark.createDataFrame(docs, "d int, m array<struct<match_type:string,term:string,confidence:double,context:string>>")
    for parts in (1, 5):
        got = {r.d: [tuple(x) for x in r.k] for r in df.repartition(parts).select("d", ranking.dedupe_similar(F.col("m")).alias("k")).collect()}
        assert got == {d: _greedy(m) for d, m in docs}


def test_longer_phrase_wins(spark):
    profile = SearchProfile("p", exact_phrases=("οδικού δικτύου", "επαρχιακού οδικού δικτύου"))
    df = spark.createDataFrame([(1, "Συντήρηση επαρχιακού οδικού δικτύου")], "doc_id int, text string")
    assert [r.term for r in links.match_terms(df, profile, "text", None, ["doc_id"]).collect()] == ["επαρχιακού οδικού δικτύου"]


def test_fuzzy_match_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(12)] + ["common"]
    title = lambda: " ".join(rng.sample(vocabulary, rng.randint(1, 6)) + ["common"])
    rows = [(f"r{i}", title(), rng.choice(["north council", "south council", "port"]), rng.choice(["north", None]), [f"o{rng.randint(0, 59)}"] if rng.random() < 0.3 else []) for i in range(60)]
    official = [(f"o{i}", title(), rng.choice(["north council", "south", "port"]), f"2026-01-{i % 28 + 1:02d}") for i in range(60)]
    toks = lambda s: set(w for w in re.findall("[a-z0-9]{4,}", s))
    ov = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
    want = {}
    for key, t, a, place, linked in rows:
        best = None
        for oid, ot, oa, dl in official:
            score = 0.62 * ov(toks(t), toks(ot)) + (0.28 if a in oa or oa in a or ov(toks(a), toks(oa)) >= 0.5 else 0) + (0.12 if place and place in oa else 0) + (0.5 if oid in linked else 0)
            if min(score, 1.0) >= 0.72:
                best = max(best or (0, "", ""), (round(min(score, 1.0), 3), dl, oid))
        if best:
            want[key] = best
    r = spark.createDataFrame(rows, "row_key string, title string, authority string, place string, linked_ids array<string>")
    o = spark.createDataFrame(official, "registry_id string, title string, authority string, deadline string")
    got = {x.row_key: (x.score, x.deadline, x.registry_id) for x in links.fuzzy_best_match(r, o).collect()}
    assert got == want and want


def test_budget_line_and_blocks(spark):
    regular = "Α/Α Περιγραφή Ποσότητα Τιμή\n 1 Β-29.3 Σκυρόδεμα C16/20 ΟΔΟ-2532 m3 22,50 25,40 571,50\n 2 ΟΔΟ 3121 Υπόβαση μεταβλητή m\n 2 120,00 19,10 2.292,00\n1204 Β-29.3 Σκυρόδεμα C16/20 ΟΔΟ-2532 m3 1,00 25,40 25,40\nΣΥΝΟΛΟ"
    block = "   23     Β-18.6      Φράκτης απορρόφησης ενεργείας\n     μέχρι 2000 kJ ύψους 5 m\n     30%Ο∆Ο-2312+\n     40%Ο∆Ο-2653+\n     30%Ο∆Ο-2311\n     m        100.00       1.680.00      168.000.00\n"
    df = spark.createDataFrame([(1, regular)], "d int, text string")
    rows = {r.row_number: r for r in budget_text.budget_lines(df, "text", ["d"]).collect()}
    assert (rows[1].article_code, rows[1].unit, float(rows[1].quantity), float(rows[1].amount), rows[1].revision_codes) == ("Β-29.3", "m3", 22.5, 571.5, ["ΟΔΟ-2532"])
    assert (rows[2].unit, float(rows[2].quantity), float(rows[2].unit_price), float(rows[2].amount)) == ("m2", 120, 19.1, 2292)
    assert sorted(rows) == [1, 2, 1204] and float(rows[1204].amount) == 25.4
    b = budget_text.block_lines(spark.createDataFrame([(1, block)], "d int, text string"), "text", ["d"]).first()
    assert (b.row_number, b.canonical_article_code, b.unit, float(b.quantity), float(b.unit_price), float(b.amount)) == (23, "Β18.6", "m", 100, 1680, 168000)
    assert set(b.revision_codes) == {"30%ΟΔΟ-2312", "40%ΟΔΟ-2653", "30%ΟΔΟ-2311"}


def test_total_candidates(spark):
    texts = ["ΣΥΝΟΛΟ  49,816.00  49,816.00\nΔΑΠΑΝΗ ΕΡΓΑΣΙΩΝ 72,649.57\nΣΥΝΟΛΙΚΗ ΔΑΠΑΝΗ ΕΡΓΑΣΙΩΝ 85,000.00",
             "Σύνολο = 850,00 Kgr\nΣΥΝΟΛΟ ΧΩΡΩΝ ΠΑΙΔΙΚΟΥ ΣΤΑΘΜΟΥ 170,51τμ\nΣύνολο Κόστους Εργασιών Σ1: 93.574,13 Π1:", "ΣΥΝΟΛΟ 1.148.787,69 € 100,00%", "Σύνολο Δαπάνης του Έργου Σ2: 110.417,47 Π2: 0,00"]
    df = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    got = {}
    for r in budget.total_candidates(df, "text", ["d"]).orderBy("d", "line_number").collect():
        got.setdefault(r.d, []).append(float(r.amount))
    assert got == {0: [49816, 72649.57, 85000], 1: [93574.13], 2: [1148787.69], 3: [110417.47]}


def test_overlay_of_best_lines(spark):
    cols = "p int, row_number int, source_document string, unit string, quantity decimal(24,6), unit_price decimal(24,6), amount decimal(24,6), confidence double, raw_text string, line_id int"
    from decimal import Decimal as D

    df = spark.createDataFrame([(1, 3, "ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ.pdf", "m", D(4), D(75), D(5), 0.9, "", 1), (1, 3, "ΠΡΟΥΠΟΛΟΓΙΣΜΟΣ.pdf", "m", D(130), D(15), D(1950), 0.9, "", 2), (1, 1, "ΤΕΧΝΙΚΗ ΕΚΘΕΣΗ.pdf", "m", D(1), D(2), D(2), 0.9, "", 3)], cols)
    got = {r.row_number: float(r.amount) for r in budget.best_line(df, "p").collect()}
    assert got == {3: 1950.0, 1: 2.0}


def test_documents_without_text_are_not_searchable(spark):
    docs = spark.createDataFrame([(1, 1, "text", "en"), (2, 2, "", "en"), (3, 3, None, "en"), (4, 9, "no attachment", "en")], "doc_id long, attachment_id long, text string, document_type string")
    attachments = spark.createDataFrame([(1, 7, "a.pdf", True), (2, 7, "b.pdf", True), (3, 7, "c.pdf", False)], "attachment_id long, tender_id long, name string, is_latest boolean")
    tenders = spark.createDataFrame([(7, "e7", "title")], "tender_id long, eshidis_id string, title string")
    assert [r.doc_id for r in links.searchable_documents(docs, attachments, tenders).collect()] == [1]
    assert sorted((r.attachment_id, r.text) for r in links.attachments_with_documents(attachments, docs).collect()) == [(1, "text"), (2, "")]
    shown = {r.attachment_id: r["sample"] for r in links.document_preview(tenders, attachments, docs, "tender_id").collect()}
    assert shown == {1: "text", 2: None}


def test_marks_over_rows_equal_the_fold(spark):
    rng = random.Random(11)
    rows = [(g, i, rng.choice(["~", "~", "~", str(rng.randint(1, 50)), "x", None])) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, mark string")
    want = {}
    for g in ("a", "b", None):
        last = None
        for _, i, m in (r for r in rows if r[0] == g):
            number = (last + 1 if last is not None else None) if m == "~" else int(m) if m and m.isdigit() else None
            last = number if number is not None else last
            want[g, i] = number
    for width in (1, 3, 7, 100):
        got = {(r.g, r.i): r.number for r in ranking.fill_marker_rows(df, "g", "i", "mark", F.floor(F.col("i") / width)).collect()}
        assert got == want, width
