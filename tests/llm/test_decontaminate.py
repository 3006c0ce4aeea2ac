import random
from collections import Counter

import numpy as np

from deltion.llm import decontaminate as dc
from tests.llm.helpers import write


def words(text):
    return dc.Words().split([text.encode()])[0].tolist()


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def brute(docs, items, settings):
    """Pairs whose item is in order around any window, for all windows of all documents."""
    out, seen, passages = set(), Counter(), 0
    for _, text in docs:
        d = words(text or "")
        for k in range(0, len(d), settings.passage):
            seen.update({dc.feature_of(np.array([w], np.uint64), settings)[0] for w in set(d[k : k + settings.passage])})
            passages += 1
    telling = lambda ws: [w for w in ws if seen[dc.feature_of(np.array([w], np.uint64), settings)[0]] <= settings.common * passages]
    for i, text in docs:
        d = words(text or "")
        for j, t in items:
            w = words(t or "")
            if not w:
                continue
            scale, whole = dc.scale_of(len(w), settings), len(telling(w)) < settings.least_words
            w = w if whole else telling(w)
            if len(set(w) & set(d)) < 0.4 * len(set(w)):
                continue
            for first in range(0, max(1, len(d) - scale + settings.block), settings.block):
                around = d[max(0, first - scale // 2) : first + scale + scale // 2]
                if whole:
                    if any(around[k : k + len(w)] == w for k in range(len(around))):
                        out.add((i, j))
                    continue
                around = telling(around)
                found, share = plain_lcs(w, around), plain_lcs(w[-8:], around) / len(w[-8:])
                if found >= settings.near_exact * len(w) or found >= settings.paraphrase * len(w) and share >= settings.answer_share:
                    out.add((i, j))
    return out


def fixture():
    rng = random.Random(4)
    syllables = ["ka", "mo", "ri", "te", "su", "no", "li", "éa", "vo", "pe", "qui", "zar", "hen", "bol", "dy"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    text = lambda n: " ".join(rng.choice(["the", "of", word(), word(), word()]) for _ in range(n))
    items = [(k, text(rng.randint(12, 70)).capitalize() + ".") for k in range(25)] + [(90, None), (91, " "), (None, text(30))]
    docs, planted = [], set()
    for i in range(160):
        t = text(rng.randint(0, 300))
        if i % 3 == 0:
            j, item = items[rng.randrange(25)]
            own = item.split()
            if i % 2:
                for _ in range(max(1, len(own) // 12)):
                    own[rng.randrange(len(own) // 2)] = word()
            cut = rng.randint(0, len(t))
            t = t[:cut] + " " + (" ".join(own).upper() if i % 4 == 0 else " ".join(own)) + " " + t[cut:]
            planted.add((i, j))
        docs.append((i, t))
    return docs + [(None, items[-1][1]), (None, items[-1][1]), (700, None), (701, ""), (702, "the of and " * 500)], items, planted


def test_pairs_against_brute_force(spark):
    docs, items, planted = fixture()
    found = dc.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got, want = {(r.doc_id, r.item_id) for r in found}, brute(docs, items, dc.Settings())
    assert got <= want and len(got & want) >= 0.95 * len(want) and len(got & planted) >= 0.95 * len(planted)
    assert len([r for r in found if r.doc_id is None]) == 2 and all(0.5 <= r.cosine <= 1.0001 for r in found)
    kept = dc.without_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, [r for r in spark.createDataFrame(docs, "doc_id long, text string").collect() if r.doc_id not in {i for i, _ in got}]))


def test_items_in_blocks(spark):
    docs, items, _ = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    at_once = {(r.doc_id, r.item_id) for r in dc.find_items(d, b).collect()}
    assert {(r.doc_id, r.item_id) for r in dc.find_items(d, b, dc.Settings(items_at_once=6)).collect()} == at_once


def test_answer_decides_on_paraphrases(spark):
    rng = np.random.default_rng(0)
    own = [f"w{k}" for k in rng.integers(0, 10**6, 40)]
    changed = [w if k % 3 else "other" for k, w in enumerate(own)]
    rows = [(k, " ".join(f"v{x}" for x in rng.integers(0, 3000, 200))) for k in range(300)]
    docs = spark.createDataFrame([*rows, (1000, " ".join(changed)), (1001, " ".join([*changed, "zebra", "quilt"]))], "doc_id long, text string")
    found = dc.find_items(docs, spark.createDataFrame([(1, " ".join(own), "zebra quilt")], "item_id long, text string, answer string")).collect()
    assert [(r.doc_id, r.kind) for r in found] == [(1001, "paraphrase")]


def test_query_on_given_and_empty_tables(spark, tmp_path):
    from deltion.llm.queries import op5_benchmark_lsa

    assert op5_benchmark_lsa(spark, write(spark, tmp_path / "e")).collect() == []
    assert op5_benchmark_lsa(spark, write(spark, tmp_path / "n", documents=[(1, "a b c", None, None, 5)])).collect() == []
    docs, items, planted = fixture()
    folder = write(spark, tmp_path / "t", documents=[(i, t, None, None, 0) for i, t in docs], benchmark=items)
    assert len({(r.doc_id, r.item_id) for r in op5_benchmark_lsa(spark, folder).collect()} & planted) >= 0.95 * len(planted)


def test_words_and_order():
    assert words("Éa-b  c") == words("éA b\nC") != words("ea b c")
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randint(1, 30))], [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        places: dict = {}
        for k, w in enumerate(a):
            places[w] = places.get(w, 0) | 1 << k
        assert dc.in_order(places, len(a), b) == plain_lcs(a, b)


def test_windows_are_close_to_the_items(spark):
    settings = dc.Settings()
    assert all(n <= dc.window_of(n, settings) <= max(16, 1.25 * n + settings.block) for n in range(1, 3000))
    rng = np.random.default_rng(6)
    run = lambda n: [f"w{k}" for k in rng.zipf(1.3, n)]
    items = [(k, run(int(rng.integers(33, 42)))) for k in range(60)]
    docs = []
    for k, own in items:
        kept = [w if rng.random() < 0.75 or at >= len(own) - 8 else f"x{rng.integers(10**6)}" for at, w in enumerate(own)]
        docs.append((k, " ".join(run(120) + kept + run(120))))
    texts = [(k, " ".join(own)) for k, own in items]
    want = {p for p in brute(docs, texts, settings) if p[0] == p[1]}
    found = dc.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(texts, "item_id long, text string")).collect()
    assert len(want) >= 30 and len({(r.doc_id, r.item_id) for r in found} & want) >= 0.95 * len(want)


def test_copies_do_not_hide_an_item(spark):
    rng = np.random.default_rng(9)
    run = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    own = run(36)
    one_changed = " ".join([*run(10), *own[:20], "changed", *own[21:], *run(10)])
    docs = [(k, " ".join(run(60))) for k in range(400)] + [(1000 + k, one_changed) for k in range(200)]
    # Every copy has another word changed: its passages differ, and the item's words stay common.
    docs += [(2000 + k, " ".join([*own[:k % 36], f"v{k}", *own[k % 36 + 1 :]])) for k in range(200)]
    for chosen in (docs[:600], docs[:400] + docs[600:]):
        found = dc.find_items(spark.createDataFrame(chosen, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")).collect()
        assert {r.doc_id for r in found} == {i for i, _ in chosen if i >= 1000}
