import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from deltion.llm import suffix_array, suffix_dedup
from tests.llm.helpers import write


def brute(rows, length):
    """doc_id, n_bytes, n_removed, n_spans, sha of every row; equal places of rows with one id are not earlier than each other."""
    first = {}
    place = lambda i, s: (suffix_dedup.NO_ID if i is None else i, s)
    for i, t in rows:
        data = (t or "").encode()
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            first[w] = min(first.get(w, place(i, s)), place(i, s))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for s in range(len(data) - length + 1):
            if first[data[s : s + length]] != place(i, s):
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ü") for _ in range(rng.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages, line = [text(rng.randint(8, 60)) for _ in range(6)], text(5)
    rows = []
    for i in range(n):
        t = line + "\n" + text(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            t += p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)] + text(rng.randint(0, 20))
        rows.append((i * 3 % n, t))
    return rows + [(n + k, rng.choice(rows)[1] + ("!" if k % 2 else "")) for k in range(n // 3)]


EDGE = [(None, "x" * 150 + "y" * 150), (None, "x" * 150 + "y" * 150), (900, None), (901, ""), (902, "a" * 500), (903, "ab" * 300), (904, "é" * 120), (905, "é" * 120), (905, "é" * 120), (905, "z" + "é" * 120), (906, "\0" * 300), (907, "q" * 99), (908, "q" * 100)]


def test_query_equals_brute_force(spark, tmp_path):
    from deltion.llm.queries import op7_suffix_dedup

    rows = texts(1, 60) + EDGE
    folder = write(spark, tmp_path / "t", documents=[(i, t, None, None, 0) for i, t in rows])
    assert sorted((tuple(r) for r in op7_suffix_dedup(spark, folder).collect()), key=str) == brute(rows, 100)
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == brute(given, 100)
    assert op7_suffix_dedup(spark, write(spark, tmp_path / "e")).collect() == []


@pytest.mark.parametrize("changes", [{"WIDE": 2}, {"SHARD": 2000}, {"PIECE": 150}, {"SAMPLE_DOCS": 100}, {"WIDE": 1}, {"COMBINED": 5}])
def test_any_cut_gives_the_same(spark, monkeypatch, changes):
    for name, value in changes.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = texts(2, 40) + EDGE
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = suffix_dedup.removal_report(docs, suffix_dedup.repeated_spans(docs, 60)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 60)


def test_rewritten_text_keeps_whole_characters(spark):
    shared = "déjà vu " * 20
    docs = spark.createDataFrame([(1, "a" + shared, 5), (2, "é" + shared + "ñ", 6), (3, None, 7)], "doc_id long, text string, other int")
    got = {r.doc_id: r for r in suffix_dedup.without_spans(docs, suffix_dedup.repeated_spans(docs, 100)).collect()}
    assert got[3].text is None and got[2].other == 6 and got[2].text.startswith("é") and got[2].text.endswith("ñ") and len(got[2].text) < 12


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(300):
        n, k = int(rng.integers(0, 60)), int(rng.integers(1, 5))
        data = rng.integers(0, k, n).astype(np.uint8)
        if trial % 3 == 0 and n:
            data = np.tile(data[: max(1, n // 7)], 7)
        order = suffix_array.suffix_array(data.astype(np.int64))
        assert order.tolist() == sorted(range(len(data)), key=lambda i: bytes(data[i:]))
        for a, b, common in zip(order, order[1:], suffix_array.common_prefixes(data, order, 20)[1:], strict=False):
            x, y = bytes(data[a:]), bytes(data[b:])
            assert common == next((i for i in range(20) if x[i : i + 1] != y[i : i + 1] or i >= min(len(x), len(y))), 20)


def test_two_digit_names(monkeypatch):
    monkeypatch.setattr(suffix_array, "DIGITS", 4)
    data = np.random.default_rng(4).integers(0, 9, 3000).astype(np.uint8)
    assert suffix_array.suffix_array(data.astype(np.int64)).tolist() == sorted(range(3000), key=lambda i: bytes(data[i:]))


def test_many_equal_rows_without_id(spark):
    rng = random.Random(9)
    passage, own = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k)) for k in (40, 400))
    rows = [(1, "start " + passage + " end")] + [(None, own + passage + own)] * 10_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = [tuple(r) for r in suffix_dedup.removal_report(docs, suffix_dedup.repeated_spans(docs, length=100)).collect()]
    want = brute([rows[0], rows[1]], 100)
    assert sorted(set(got), key=str) == want and len(got) == 10_001


def test_text_ids_raise(spark):
    with pytest.raises(TypeError, match="doc_id"):
        suffix_dedup.repeated_spans(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_a_shard_takes_little_memory():
    """A task holds the arrays of one shard at a time: well under 100 MB, two tasks run beside each other in an executor."""
    import tracemalloc

    class Frame:
        def mapInArrow(self, work, schema):  # noqa: N802
            return work

    r = np.random.default_rng(1)
    same = r.bytes(140)
    contexts = [r.bytes(30) + same + r.bytes(30) if k % 2 else r.bytes(200) for k in range(40_000)]
    n = len(contexts)
    batch = pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((range(n), range(n), [0] * n, [0] * n, contexts), suffix_dedup.WINDOWS, strict=True)], schema=suffix_dedup.WINDOWS)
    work = suffix_dedup.settle_shards(Frame(), 100)
    tracemalloc.start()
    found = sum(b.num_rows for b in work(batch.slice(k, 2000) for k in range(0, n, 2000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak >> 20)
    assert found and peak < 100 << 20
