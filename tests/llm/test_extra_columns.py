"""Columns of the input that are named like those operators use inside come through unchanged."""

from deltion.llm import decontaminate, simhash, suffix_dedup, toxicity

NAMES = ["_key", "_copy", "_blank", "_spans", "_doc", "_version", "spans", "doc", "version", "row", "_i", "_t", "i", "t", "digest", "fp", "bands", "members", "toxic", "weights", "start", "end"]
ITEM = " ".join(f"item{i}" for i in range(30))
TEXTS = {1: "alpha beta gamma delta epsilon " * 8, 2: "alpha beta gamma delta epsilon " * 8, 3: "before " + ITEM + " after", 4: None, **{k: " ".join(f"w{k * i % 97}x{i}" for i in range(60)) for k in range(10, 60)}}


def docs_of(spark):
    rows = [(i, t, *(f"{n}{i}" for n in NAMES)) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def same(docs, out, ids):
    assert out.columns == docs.columns
    got = {r.doc_id: tuple(r)[2:] for r in out.collect()}
    assert got == {i: tuple(f"{n}{i}" for n in NAMES) for i in ids}


def test_all_columns_stay(spark):
    docs = docs_of(spark)
    same(docs, simhash.one_of_each(docs), [i for i in TEXTS if i != 2])
    same(docs, suffix_dedup.without_spans(docs, suffix_dedup.repeated_spans(docs, length=100)), list(TEXTS))
    benchmark = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    same(docs, decontaminate.without_contaminated(docs, benchmark), [i for i in TEXTS if i != 3])
    same(docs, toxicity.without_toxic(docs, toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))), list(TEXTS))
