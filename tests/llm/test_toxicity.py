import random

import pytest

from deltion.llm import toxicity
from tests.llm.helpers import write


def maximal_segments(weights):
    """All maximal scoring segments by their definition: the best segment, then the same left and right of it."""
    best, pick = 0.0, None
    for i in range(len(weights)):
        total = 0.0
        for j in range(i, len(weights)):
            total += weights[j]
            if total > best + 1e-9:
                best, pick = total, (i, j)
    if pick is None:
        return []
    i, j = pick
    left, right = maximal_segments(weights[:i]), maximal_segments(weights[j + 1 :])
    return [*left, (i, j, best), *((a + j + 1, b + j + 1, s) for a, b, s in right)]


def test_segments_by_definition():
    rng = random.Random(2)
    scorer = toxicity.Scorer(toxicity.Model(drift=0.25))
    for _ in range(300):
        hits = [(i, rng.uniform(0.1, 2.5)) for i in range(rng.randint(0, 40)) if rng.random() < 0.3]
        n = hits[-1][0] + 1 if hits else 0
        weights = [dict(hits).get(i, -0.25) for i in range(n)]
        got = scorer.segments(hits)
        want = maximal_segments(weights)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_segments_of_long_texts_in_linear_time():
    import time

    scorer = toxicity.Scorer(toxicity.Model(drift=0.25))
    rng = random.Random(3)
    hits = [(i, rng.uniform(0.1, 2.5)) for i in range(4000) if rng.random() < 0.5]
    assert len(scorer.segments(hits)) > 0
    for n, step, weight in ((8_000, 20, 1.0), (8_000, 1, 0.1), (8_000, 3, 0.5)):
        apart = [(i * step, weight) for i in range(n)]
        took = []
        for _ in range(3):
            start = time.perf_counter()
            found = scorer.segments(apart)
            took.append(time.perf_counter() - start)
        assert min(took) < 0.2 and sum(1 for _ in found) in (1, n)
    fall = [(i * 7, 1.0) for i in range(4000)] + [(28_000 + i, 3.0) for i in range(4000)]  # every one of the first starts higher than the last
    start = time.perf_counter()
    scorer.segments(fall)
    assert time.perf_counter() - start < 0.5


def test_long_texts_by_definition():
    rng = random.Random(5)
    scorer = toxicity.Scorer(toxicity.Model(drift=1.0))
    for _ in range(4):
        hits = [(i, float(rng.randint(1, 4))) for i in range(3000) if rng.random() < 0.4]
        got = scorer.segments(hits)
        # A maximal segment has no proper prefix or suffix that is not positive, and segments next to each other cannot be joined to a better one.
        weight, drift = dict(hits), 1.0
        values = [weight.get(i, -drift) for i in range(3000)]
        assert all(got[i][1] < got[i + 1][0] for i in range(len(got) - 1))
        covered = set()
        for a, b, s in got:
            assert sum(values[a : b + 1]) == s
            run = 0.0
            for i in range(a, b + 1):
                run += values[i]
                assert run > 0
            run = 0.0
            for i in range(b, a - 1, -1):
                run += values[i]
                assert run > 0
            covered.update(range(a, b + 1))
        assert set(weight) <= covered


def test_given_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model, passages=False).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    toxic = [r for r in got if r.toxic]
    assert len(got) > 500 and sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic), (len(toxic), sum(r.predicted for r in toxic))
    print("held-out toxic", len(toxic), "found", sum(r.predicted for r in toxic), "of", len(got), "right", sum(r.predicted == r.toxic for r in got))


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 7 == 0
        own = [word() for _ in range(rng.randint(5, 120))]
        if toxic:
            at = rng.randrange(len(own))
            own[at:at] = [rng.choice(["zulvox", "krantur", "pluvixen", "pluvixar"]) for _ in range(rng.randint(1, 4))]
        rows.append((i, " ".join(own), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_passages(spark, tmp_path):
    from deltion.llm.queries import op8_toxic_passages

    rows, labels = corpus(900)
    edge = [(None, "zulvox krantur", None, None, 0), (None, None, None, None, 0), (5000, "", "en", "s", 0), (5001, None, "en", "s", 0), (5002, "abc " * 30000 + "ZULVOX zulvox", "en", "s", 0), (5002, "abc " * 30000 + "ZULVOX zulvox", "en", "s", 0)]
    folder = write(spark, tmp_path / "t", documents=rows + edge, labels=labels + [(3, 1, None), (None, 1, 1), (7, 1, 0), (7, 1, 0)])
    got = op8_toxic_passages(spark, folder).collect()
    assert len(got) == len(rows) + len(edge) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    toxic = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert len(held) > 100 and sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.97 * len(held)
    long = [r for r in got if r.doc_id == 5002]
    assert len(long) == 2 and all(r.predicted and (r.passages[0].start, r.passages[0].end) == (120000, 120013) for r in long)
    assert all(r.predicted == 0 for r in got if r.doc_id in (5000, 5001))


def test_labels_that_are_held_out_change_nothing(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = {r[0] for r in spark.createDataFrame([(i,) for i, *_ in labels], "i long").where("crc32(cast(i as string)) % 5 = 0").collect()}
    as_is = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    other = toxicity.fit(docs, spark.createDataFrame([(i, q, 1 - t if i in held else t) for i, q, t in labels], "doc_id long, quality int, toxic int"))
    assert as_is == other


def test_without_labels_or_documents(spark, tmp_path):
    from deltion.llm.queries import op8_toxic_passages

    assert op8_toxic_passages(spark, write(spark, tmp_path / "e")).collect() == []
    rows, labels = corpus(30)
    for some, label in (([], 0), ([x for x in labels if x[2]], 1), ([x for x in labels if not x[2]], 0)):
        got = op8_toxic_passages(spark, write(spark, tmp_path / f"n{len(some)}", documents=rows, labels=some)).collect()
        assert {r.predicted for r in got} == {label}
