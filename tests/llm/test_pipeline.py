"""Every stage on what the one before it kept, against brute force; and planted cases through the whole pipeline."""

import random

import pytest

import corpus_pipeline
from deltion.llm import decontaminate, simhash, suffix_dedup, toxicity
from tests.llm.helpers import write
from tests.llm.test_bpe import expected
from tests.llm.test_decontaminate import brute as brute_items
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_suffix_dedup import brute as brute_removal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "id", "n", "key", "host"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(rng.choice(["the", "of", word(), word(), word(), word()]) for _ in range(n))
    items = [(k, text(rng.randint(25, 60))) for k in range(8)]
    passage = text(60)
    docs, labels, kinds = [], [], {}
    for i in range(300):
        t, kind = text(rng.randint(60, 250)), "clean"
        if i % 6 == 0:
            t, kind = t + " " + " ".join(rng.choice(["zulvox", "krantur"]) for _ in range(3)), "toxic"
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        if i in (11, 13, 17):
            t, kind = t + " " + items[i % 8][1] + " " + text(20), "leak"
        if i in (23, 25, 29):
            t, kind = text(30) + " " + passage + " " + text(30), "passage"
        docs.append((i, t, "en", "s", len(t)))
        kinds[i] = kind
    for i, k in ((400, 31), (401, 31), (402, 35)):
        docs.append((i, docs[k][1], "en", "s", docs[k][4]))
        kinds[i] = "copy"
    words = docs[37][1].split()
    words[5] = "changed"
    docs.append((403, " ".join(words), "en", "s", 1))
    kinds[403] = "near copy"
    edge = [(None, None, None, None, None), (None, docs[41][1], None, None, 3), (500, "", "en", "s", 0), (501, None, "en", "s", 0), (502, "déjà " * 9000, "fr", "s", 45000), docs[43]]
    return docs + edge, labels, items, kinds


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, tmp_path, corpus):
    docs, labels, items, kinds = corpus
    folder = write(spark, tmp_path / "t", documents=docs, labels=labels, benchmark=items)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: stages[name](spark, df, folder)

    scores = {(r.doc_id, r.score) for r in toxicity.score_documents(now, toxicity.fit(now, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    clean = step("toxicity", now)
    assert clean.columns == COLUMNS and {r.doc_id for r in clean.collect()} == {i for i, s in scores if s < 0.5}
    assert len(clean.collect()) == sum(1 for d in docs if d[0] not in {i for i, s in scores if s >= 0.5})

    fps = {}
    for r in clean.collect():
        fps.setdefault(brute_fingerprint(r.text, 5), []).append((r.doc_id is None, r.doc_id or 0, r.text or ""))
    want = set(brute_components(fps, 7).values())
    distinct = step("simhash", clean)
    kept = [(r.doc_id is None, r.doc_id or 0, r.text or "") for r in distinct.collect()]
    assert distinct.columns == COLUMNS and sorted(map(lambda k: k[:2], kept)) == sorted(map(lambda k: k[:2], want))

    left = step("suffix_array", distinct)
    removal = {r[0]: r for r in brute_removal([(r.doc_id, r.text) for r in distinct.collect()], 100)}
    before = {r.doc_id: r for r in distinct.collect()}
    assert left.columns == COLUMNS
    for r in left.collect():
        lost = len((before[r.doc_id].text or "").encode()) - len((r.text or "").encode())
        assert removal[r.doc_id][2] - 6 * removal[r.doc_id][3] <= lost <= removal[r.doc_id][2]
        assert r.text is None or r.n_chars == len(r.text)

    pairs = brute_items([(r.doc_id, r.text) for r in left.collect()], items, decontaminate.Settings())
    pure = step("decontamination", left)
    assert pure.columns == COLUMNS and rows_of(pure) == sorted((tuple(r) for r in left.collect() if r.doc_id not in {i for i, _ in pairs}), key=str)

    encoded = step("bpe", pure).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded), key=str) == sorted(((r.doc_id, *expected(r.text)) for r in pure.collect()), key=str)
    assert all(len(r.ids) == r.n_tokens for r in encoded)

    out = {r.doc_id for r in encoded}
    assert not out & {i for i, k in kinds.items() if k in ("toxic", "leak", "copy", "near copy")}
    assert {i for i, k in kinds.items() if k in ("clean", "passage")} <= out


def test_whole_run_and_empty_tables(spark, tmp_path, corpus):
    docs, labels, items, kinds = corpus
    got = corpus_pipeline.run(spark, write(spark, tmp_path / "t", documents=docs, labels=labels, benchmark=items)).collect()
    assert {i for i, k in kinds.items() if k in ("clean", "passage")} <= {r.doc_id for r in got} and not {i for i, k in kinds.items() if k in ("toxic", "leak", "copy", "near copy")} & {r.doc_id for r in got}
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "e")).collect() == []


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "decontamination", "bpe"]
    assert simhash.CELL >= 1 << 7 and suffix_dedup.GRAM * 2 <= 100
