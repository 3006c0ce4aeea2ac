"""Steps whose cost grew faster than their tables: what a plan repeats, and the same results as before."""

import re

import pytest
from pyspark.sql import functions as F

from deltion.catalog import load
from deltion.functions import text
from deltion.operators.links import fuzzy_best_match
from deltion.operators.ranking import marker_unit_prices

QUERIES, _ = load()


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["k2_dashboard", "k4_reverse_search", "k8_explain_row", "k9_digest_attention"])
def test_places_are_searched_once(spark, name):
    # Rows and their places are written; no later step (sort, branch, pushed filter) searches the texts for places again.
    assert "nation_7" not in _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_digest_is_not_sorted(spark):
    assert "Sort [deadline_sort" not in _plan(QUERIES["k9_digest"](spark, "/root/testdata/sf0.001"))


def test_word_bounds(spark):
    texts = ["nation 7", "a nation 7.", "nation 77, nation 7", "nation 77", "xnation 7", "ένας", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.f for r in df.select(text.word_bounded(F.col("t"), "nation 7").alias("f")).collect()]
    assert got == [True, True, True, False, False, False, False, None]


def test_dates_are_read_once(spark):
    assert _plan(QUERIES["i7_extract_dates"](spark, "/root/testdata/sf0.001")).count("regexp_extract_all") == 2  # two ways to write a date


def test_names_are_folded_once_for_their_rank(spark):
    # Once for the rank, once for the order.
    assert _plan(QUERIES["f5_top_evidence"](spark, "/root/testdata/sf0.001")).count("regexp_replace") == 2


def test_external_lines_are_parsed_once(spark):
    assert "regexp_replace" not in _plan(QUERIES["e26_accept_external_lines"](spark, "/root/testdata/sf0.001"))


def test_markers_are_searched_once(spark):
    texts = ["x\nA.T.: 5\n(Αριθμητικώς): 1,50\nΑΤ : 6\nno price", "A.T. :\n7\n(Αριθμητικώς): 2", "no marker: here", "A.T. 5", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(marker_unit_prices(F.col("t")).alias("p"))
    assert [{k: float(v) for k, v in r.p.items()} for r in df.collect()] == [{5: 1.5}, {}, {}, {}, {}, {}]
    assert _plan(QUERIES["f18_marker_unit_prices"](spark, "/root/testdata/sf0.001")).count(r"\b[AΑ]") == 1


def test_places_are_found_plainly_first(spark):
    # The expression is tried only in texts that hold the place's name at all.
    df = spark.createDataFrame([("a nation 7.",)], "t string").select(text.word_bounded(F.col("t"), "nation 7").alias("f"))
    assert "Contains(t" in _plan(df)


def test_fuzzy_pairs_are_scored_where_they_meet(spark):
    # Candidate pairs are not gathered before they are scored: no aggregation has the words of both titles as its key.
    assert not re.search(r"Aggregate \[[^\]]*\btok#[^\]]*\bo_tok#", _plan(QUERIES["d13_fuzzy_best_match"](spark, "/root/testdata/sf0.001")))


def test_fuzzy_match_at_the_threshold(spark):
    # 31 words of which as many are shared as the threshold asks for, with and without a place; the longer title on either side.
    words = [f"word{i:03d}" for i in range(70)]
    title = lambda shared, own: " ".join(words[:shared] + [f"{own}{i:03d}" for i in range(31 - shared)])
    rows = [(f"{n}{place}", title(n, f"left{n}x"), "council one", place, []) for n in (15, 16, 21, 22, 23) for place in ("", "council")]
    schema = "row_key string, title string, authority string, place string, linked_ids array<string>"
    for more in ([], [f"more{i:03d}" for i in range(9)]):
        official = spark.createDataFrame([("7", " ".join(words[:31] + more), "council one", "")], "registry_id string, title string, authority string, deadline string")
        got = {r.row_key for r in fuzzy_best_match(spark.createDataFrame(rows, schema), official).collect()}
        assert got == {k for k, t, _, place, _ in rows if int(k[:2]) / 31 * 0.62 + 0.28 + (0.12 if place else 0.0) >= 0.72}


def test_keywords_are_cleaned_once(spark):
    df = spark.createDataFrame([("Ένα,  ένα ;\u00a0δύο  τρία\n,,ΔΎΟ τρία;b\u00e9,BE,,c",), ("",), (None,)], "t string").select(text.keyword_list(F.col("t"), cap=3).alias("k"))
    assert [r.k for r in df.collect()] == [["Ένα", "δύο τρία", "bé"], [], []]
    assert _plan(QUERIES["i19_keyword_list"](spark, "/root/testdata/sf0.001")).count("regexp_replace") == 1


def test_texts_without_references_are_not_searched_for_them(spark):
    texts = ["a &amp;lt; b", "&#65;&#x42;&nbsp;c &unknown; &", "plain", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.unescape(F.col("t")).alias("u"))
    assert [r.u for r in df.collect()] == ["a &lt; b", "AB\u00a0c &unknown; &", "plain", "", None]
    assert re.search(r"CASE WHEN Contains\([^,]+, &\) THEN", _plan(df))
