"""Scalar functions on literals."""

from pyspark.sql import functions as F

from deltion.functions import codes, dates, extract, numbers, text


def values(spark, items, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.v for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]


def test_fold(spark):
    assert values(spark, ["ΟΔΌΣ  Αθηνών", "ΐΰ Ü", "a_b c"], text.norm_text) == ["οδοσ αθηνων", "ιυ u", "a_b c"]
    assert text.fold_term("Οδός") == "οδοσ"


def test_locale_numbers(spark):
    got = values(spark, ["1.200", "12.500", "100.00", "46,750.00", "72,649.57", "1.680.00", "1.234,56*", "x", ""], numbers.parse_locale_number)
    assert [None if v is None else float(v) for v in got] == [1200, 12500, 100, 46750, 72649.57, 1680, 1234.56, None, None]


def test_codes(spark):
    assert values(spark, ["Β-18.6", "B18.6", " b - 18.6 "], codes.canonical_article_code) == ["Β18.6"] * 3
    assert values(spark, ["Ο∆Ο-2312", "ODO 2653"], codes.canonical_revision_code) == ["ΟΔΟ-2312", "ΟΔΟ2653"]
    assert values(spark, ["30%Ο∆Ο-2312+ 40%Ο∆Ο-2653+ 30%Ο∆Ο-2311"], codes.revision_codes) == [["30%ΟΔΟ-2312", "40%ΟΔΟ-2653", "30%ΟΔΟ-2311"]]


def test_official_ids(spark):
    texts = [
        "Α/Α Συστήματος ΕΣΗΔΗΣ 221566 resources/search/221556", "αριθμός συστήματος 221566", "ΕΣΗΔΗΣ: 76928", "αριθμός 76928",
        "publicworks.eprocurement.gov.gr Α/Α Διαγωνισμού 221700", "Α/Α Διαγωνισμού 221700",
        "ΕΝΤΥΠΟ ΟΙΚΟΝΟΜΙΚΗΣ ΠΡΟΣΦΟΡΑΣ Α/Α Συστήματος 221701",
    ]
    assert values(spark, texts, extract.official_ids) == [["221566"], [], ["76928"], [], ["221700"], [], ["221701"]]


def test_deadline_evidence(spark):
    body = "Η καταληκτική προθεσμία υποβολής προσφορών ορίζεται η 20/08/2026 ώρα 10:00. Πρωτόκολλο 31/13/2026."
    best = values(spark, [body, "χωρίς 2026-01-01"], dates.deadline_evidence)
    assert best[0].deadline_at == "2026-08-20 10:00" and abs(best[0].confidence - 0.65) < 1e-9
    assert best[1] is None


def test_summer_time(spark):
    got = values(spark, ["16-02-2026 15:00", "16-07-2026 15:00", "16-07-2026", "2026-07-16T15:00:00+00:00", "soon"], lambda c: F.date_format(dates.deadline_instant(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2026-02-16 13:00:00", "2026-07-16 12:00:00", "2026-07-16 20:59:59", "2026-07-16 15:00:00", None]


def test_entities(spark):
    assert values(spark, ["&#913;&#x3B2; &amp;amp; &euro;5 &nope; &#xZZ;"], text.unescape) == ["Αβ &amp; €5 &nope; &#xZZ;"]


def test_keyword_list(spark):
    assert values(spark, ["Οδός, ΟΔΟΣ;\n , δρόμος"], text.keyword_list) == [["Οδός", "δρόμος"]]
    assert len(values(spark, [",".join(f"w{i}" for i in range(60))], text.keyword_list)[0]) == 40


def test_project_title(spark):
    bodies = ["ΤΙΤΛΟΣ ΕΡΓΟΥ: Βελτίωση οδού Ιτέας ΥΠΟΕΡΓΟ 2", "ΤΙΤΛΟΣ ΕΡΓΟΥ: GR1601101250000000012300695 ΥΠΟΕΡΓΟ", "για το έργο/α: Συντήρηση δικτύου Επωνυμία δικαιούχου Χ"]
    assert values(spark, bodies, extract.project_title) == ["Βελτίωση οδού Ιτέας", None, "Συντήρηση δικτύου"]


def test_clean_knows_every_space(spark):
    from pyspark.sql import functions as F

    from deltion.functions.text import WS, clean

    rows = spark.createDataFrame([(i, f"a{chr(i)}{chr(i)}b") for i in [*range(1, 0xD800), *range(0xE000, 0x10000)]], "i int, x string")
    assert rows.where(clean(F.col("x")) != F.trim(F.regexp_replace("x", f"{WS}+", " "))).count() == 0
