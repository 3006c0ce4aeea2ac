import public_tokenizers
import tiktoken
from collections import Counter

from deltion.llm import token_counts
from deltion.llm.queries import op4_token_lengths
from tests.llm.helpers import write

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(texts):
    own = token_counts.encoding(PATH, public_tokenizers.PATTERN)
    assert isinstance(own, tiktoken.Encoding)
    lengths = [len(own.encode_ordinary(t or "")) for t in texts]
    rows = {}
    for n, docs in Counter(lengths).items():
        longer, up_to = sum(x > n for x in lengths), [x for x in lengths if x <= n]
        rows[n] = (docs, n * docs, longer + docs, longer, len(up_to), sum(up_to), sum(min(x, n) for x in lengths), len(up_to) / len(lengths), len(lengths), sum(lengths))
    return lengths, rows


def test_histogram_and_answers(spark, tmp_path):
    texts = [None, "", "a", "a", "hello world", "hello world " * 3000, "é" * 5000, "<|endoftext|>"] + [f"w{i} " * (i % 70) for i in range(300)]
    folder = write(spark, tmp_path / "t", documents=[(i if i else None, t, None, None, 0) for i, t in enumerate(texts)])
    for where in (folder, "/root/testdata/sf0.001"):
        lengths, rows = brute([r.text for r in spark.read.parquet(f"{where}/documents.parquet").collect()])
        sums = op4_token_lengths(spark, where)
        assert {r[0]: tuple(r[1:]) for r in sums.collect()} == rows
        limits = [0, 1, 2, 17, 512, 2048, 4096, max(lengths), max(lengths) + 5]
        assert token_counts.at_limits(sums, limits) == {x: sum(min(x, n) for n in lengths) for x in limits}
        ordered = sorted(lengths)
        assert token_counts.quantiles(sums, [0.0, 0.25, 0.5, 0.99, 1.0]) == {q: ordered[max(1, -(-int(q * 100) * len(ordered) // 100)) - 1] for q in (0.0, 0.25, 0.5, 0.99, 1.0)}


def test_empty_table(spark, tmp_path):
    sums = op4_token_lengths(spark, write(spark, tmp_path / "e"))
    assert sums.collect() == [] and token_counts.at_limits(sums, [5]) == {5: 0} and token_counts.quantiles(sums, [0.5]) == {0.5: None}
