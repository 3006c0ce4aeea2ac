from deltion.llm import host_quality
from tests.llm.helpers import against_sql, write

WORDS = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", " \t\n", "a b c a b c", "a b c d", "a a a a a a", WORDS, WORDS + "\n" + WORDS, ("x y z " * 40), "line\nline\n \n\nline\nother", "#*$%&|<> é b c\x0bd\x1fe", "# " * 80, WORDS + " tail" * 3, "one", "one two", "one two three", WORDS * 300]


def test_edge_rows(spark, tmp_path):
    rows = [(i, t, "en", None if i % 4 == 3 else f"s{i % 4}", 0) for i, t in enumerate(TEXTS)]
    assert against_sql(spark, write(spark, tmp_path / "t", documents=rows + [(None, WORDS, None, "s1", 0)] * 3), "op6_host_quality") == []
    assert against_sql(spark, write(spark, tmp_path / "e"), "op6_host_quality") == []


def test_given_documents(spark):
    assert against_sql(spark, "/root/testdata/sf0.001", "op6_host_quality") == []


def test_bad_host_takes_its_documents_along(spark):
    rows = [(i, WORDS if i % 10 == 0 else "short", "bad") for i in range(1000)] + [(2000 + i, WORDS, "good") for i in range(1000)] + [(5000, "short", "tiny")]
    got = {r.doc_id: r for r in host_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0].base_failed and not got[0].kept and got[2000].kept
    assert 0.2 < got[5000].host_rate < 0.95
    assert [r for r in host_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), reject_rate=1.0).collect() if r.doc_id == 0][0].kept


def test_no_python_in_the_plan(spark):
    plan = host_quality.text_counters(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
