import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from deltion.llm import bpe
from tests.llm.helpers import write

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    packed = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_equals_the_library(spark, tmp_path):
    from deltion.llm.queries import op10_bpe_prefix

    edge = [None, "", " \n", "It's I'LL we've", "a" * 30000, "ab1234  日本語 ΣΑΣ İ Ǆ é é", "x<|endoftext|>y <|startoftext|>", "<|endoftext|", "!!!...##", "\x1c\x85\u2028z", "\ud7ff\ue000"]
    folder = write(spark, tmp_path / "t", documents=[(i, t, None, None, 0) for i, t in enumerate(edge)] + [(None, "same", "en", "s", 4)] * 2)
    for where in (folder, "/root/testdata/sf0.001"):
        text = {(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
        got = {tuple(r) for r in op10_bpe_prefix(spark, where).collect()}
        assert got == {(i, *expected(t)) for i, t in text}
    assert op10_bpe_prefix(spark, write(spark, tmp_path / "e")).collect() == []


def test_random_texts():
    own, rng = bpe.WordBpe(PATH), random.Random(3)
    letters = "aabbccddeeoorrtths'lé Σ123\t!.#-日́<|endoftext|>"
    words = [t.replace("</w>", "") for t in own.names.values()]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) if rng.random() < 0.6 else "".join(rng.choice(words) for _ in range(3))
        packed, n, decoded = own.encode(text)
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert packed == b"".join(i.to_bytes(4, "little") for i in ids) and n == len(ids) and decoded == own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["a", "ab", "ha", "!", "é"])
def test_long_words(unit):
    assert bpe.WordBpe(PATH).encode(unit * 4000)[1] == len(LIBRARY.encode(unit * 4000, add_special_tokens=False).ids)
