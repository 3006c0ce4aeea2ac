import random

import numpy as np

from deltion.llm import language
from tests.llm.helpers import write

PARTS = {"xx": ["tha", "sho", "wing", "the "], "yy": ["éau", "ouè", "ment", "les "], "zz": ["ung", "sch", "keit", "der "]}


def text(lang, n, rng):
    return "".join(rng.choice(PARTS[lang]) for _ in range(n))


def test_held_out_accuracy_and_edge_rows(spark, tmp_path):
    from deltion.llm.queries import op9_language_id

    rng = random.Random(3)
    rows = [(i, text(lang := ["xx", "yy", "zz"][i % 3], rng.randint(5, 400), rng), lang, "s", 0) for i in range(600)]
    edge = [(1000, None, "xx", "s", 0), (1001, "", "xx", "s", 0), (1002, "123 !?", "xx", "s", 0), (1003, text("yy", 30000, rng), None, None, 0), (None, text("zz", 50, rng), None, None, 0), (None, text("zz", 50, rng), None, None, 0)]
    got = op9_language_id(spark, write(spark, tmp_path / "t", documents=rows + edge)).collect()
    assert len(got) == len(rows) + len(edge) and all(0 <= r.score <= 1 for r in got)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert len(held) > 80 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert {by_id[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by_id[1003].lang_pred == "yy" and by_id[None].lang_pred == "zz"


def test_nothing_to_learn_from(spark, tmp_path):
    from deltion.llm.queries import op9_language_id

    assert op9_language_id(spark, write(spark, tmp_path / "e")).collect() == []
    got = op9_language_id(spark, write(spark, tmp_path / "n", documents=[(1, "abc", None, "s", 0)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_windows_cover_the_text_and_batches_change_nothing():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3001, dtype=np.uint8).tobytes()
    found = language.windows(data, 256, 3)
    joined = found[0].tolist() + [x for w in found[1:] for x in w[3:].tolist()]
    assert bytes(x for x in joined if x != language.PAD) == data
    model = language.train([("abc abd", "a"), ("xyz xyw", "b")] * 20, language.Settings(epochs=3))
    both = language.probabilities(model, found, chunk=5)
    assert np.allclose(both, np.concatenate([language.probabilities(model, found[k : k + 1]) for k in range(len(found))]), atol=1e-5)


def test_gradient_is_the_slope():
    """Training on separable text drives the loss down, which a wrong gradient would not."""
    rng = random.Random(5)
    rows = [(text(lang, 60, rng), lang) for lang in PARTS for _ in range(60)]
    model = language.train(rows, language.Settings(epochs=6))
    right = [language.probabilities(model, language.windows(t.encode(), model.window, model.width - 1)).mean(0).argmax() == model.languages.index(lang) for t, lang in rows]
    assert np.mean(right) > 0.98
