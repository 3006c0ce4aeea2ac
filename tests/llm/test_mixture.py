import itertools
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from deltion.llm import mixture
from tests.llm.helpers import against_sql, write


def rows(spark):
    words = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    out = [(i, words(5 + i * 7 % 400), "en", ("hot", "b", "é", None, "zero")[min(i % 7, 3)] if i % 11 else "zero", 0) for i in range(300)]
    out = [(i, None if s == "zero" and i % 2 else " \n" if s == "zero" else t, x, s, n) for i, t, x, s, n in out]
    return out + [(None, words(90), "en", "hot", None)] * 400 + [(7, words(20000), "en", "b", 1), (8, "one", None, "tiny", 3)]


def test_edge_rows_against_sql(spark, tmp_path):
    assert against_sql(spark, write(spark, tmp_path / "t", documents=rows(spark)), "op11_sainte_lague") == []
    assert against_sql(spark, write(spark, tmp_path / "e"), "op11_sainte_lague") == []
    assert against_sql(spark, write(spark, tmp_path / "n", documents=[(1, None, None, None, None)] * 3), "op11_sainte_lague") == []


def test_given_documents(spark):
    assert against_sql(spark, "/root/testdata/sf0.001", "op11_sainte_lague") == []


def test_quotas_are_those_of_highest_quotients(spark):
    cases = {"a": [5, 3, 1, 1], "b": [1000, 1, 1, 1, 1, 1, 1, 1], "c": [7] * 9, "d": [0, 0, 3], "e": [0, 0], "f": [1] * 50 + [49]}
    for seats in (0, 1, 2, 7, 100, 1001):
        given = [(g, i, w, seats) for g, ws in cases.items() for i, w in enumerate(ws)]
        got = {(r.g, r.i): r.quota for r in mixture.apportion(spark.createDataFrame(given, "g string, i int, w long, seats long"), ["g"], "w", "seats", "i", "quota").collect()}
        for g, ws in cases.items():
            won = Counter(i for _, i in sorted((-w / (2 * k + 1), i) for i, w in enumerate(ws) if w for k in range(seats))[:seats])
            assert [got[g, i] for i in range(len(ws))] == [won[i] for i in range(len(ws))], (g, seats)


def test_targets_are_met_and_nothing_is_taken_too_often(spark):
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string, lang string, source string, n_chars long")
    got = mixture.mix(docs, [5, 2, 1]).collect()
    assert len(got) == docs.count()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and all(1 <= s.times <= 3 and s.words > 0 and s["first"] + s.words <= r.size for s in r.spans or [])
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    for s, t in target.items():
        assert t <= 3 * size[s] and abs(taken[s] - t) <= max(100, 0.02 * t), (s, t, taken[s])
    again = mixture.mix(docs.repartition(13, F.rand()), [5, 2, 1]).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.spans))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sorted(map(key, got)) != sorted(map(key, mixture.mix(docs, [5, 2, 1], seed="other").collect()))


def test_sections_and_shards(spark):
    docs = spark.createDataFrame([(i, "w " * (20 + i % 50), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    got = mixture.mix(docs, [5, 2, 1], shard_words=2000, shards_per_section=4).collect()
    assert len({r.section for r in got}) > 3
    for s, g in itertools.groupby(sorted(got, key=lambda r: r.source), key=lambda r: r.source):
        g = list(g)
        assert abs(sum(r.taken for r in g) - g[0].target) < 0.02 * g[0].target, s


def test_texts_of_blocks(spark):
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixture.mix(docs, [5, 2, 1])
    texts = mixture.block_texts(docs, mixed).collect()
    assert sum(len(r.text.split()) * r.times for r in texts) == mixed.agg(F.sum("taken")).first()[0]
    assert any("w0 w1 w2" in r.text for r in texts)
