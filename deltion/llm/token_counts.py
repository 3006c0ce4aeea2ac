"""Exact histogram of encoded lengths, and suffix sums that answer for every context limit."""

from __future__ import annotations

import base64
import functools
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

BUCKET = 1024


@functools.cache
def encoding(path: str, pattern: str):
    """The rank file at `path` as an encoding; one instance per Python worker."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """Number of documents of every encoded length: (n_tokens, docs).

    Every whole text is encoded; strings of special tokens are ordinary text. Null and empty texts have length 0; an
    empty table gives no rows. A task counts what it reads before the shuffle, so one frequent length costs one row per
    task; a task holds one counter entry per length.
    """

    def work(batches):
        own, lengths = encoding(path, pattern), Counter()
        for batch in batches:
            for text in batch.column(0):
                lengths[len(own.encode_ordinary(text.as_py() or ""))] += 1
        yield pa.RecordBatch.from_pydict({"n_tokens": list(lengths), "docs": list(lengths.values())}, schema=pa.schema([("n_tokens", pa.int64()), ("docs", pa.int64())]))

    return docs.select(text_column).mapInArrow(work, "n_tokens long, docs long").groupBy("n_tokens").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length: documents at least as long and longer, tokens up to it, and the total truncated to it.

    Between two lengths the truncated total is linear in the limit, so these rows answer for every limit. Running sums
    are taken inside buckets of 1 024 lengths and continued over the bucket totals (one row per 1 024 lengths), so no
    task sorts the whole histogram.
    """
    rows = histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BUCKET).alias("bucket"))
    totals = rows.groupBy("bucket").agg(F.sum("docs").alias("bucket_docs"), F.sum("tokens").alias("bucket_tokens"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "bucket", F.coalesce(F.sum("bucket_docs").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("bucket_docs").over(everything).alias("all_docs"), F.sum("bucket_tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("bucket").orderBy("n_tokens")
    up_to = rows.join(totals, "bucket").withColumns({"docs_up_to": F.col("docs_before") + F.sum("docs").over(inside), "tokens_up_to": F.col("tokens_before") + F.sum("tokens").over(inside)})
    longer = F.col("all_docs") - F.col("docs_up_to")
    return up_to.select(
        "n_tokens", "docs", "tokens", (longer + F.col("docs")).alias("docs_at_least"), longer.alias("docs_longer"), "docs_up_to", "tokens_up_to",
        (F.col("tokens_up_to") + F.col("n_tokens") * longer).alias("truncated_tokens"), (F.col("docs_up_to") / F.col("all_docs")).alias("quantile"), "all_docs", "all_tokens",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> dict[int, int]:
    """Tokens that are left when every document is cut to the limit, for each limit; 0 over no documents."""
    wanted = [F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "tokens_up_to", "tokens", "docs_at_least"))).alias(str(i)) for i, limit in enumerate(limits)]
    row = sums.agg(F.max("all_tokens").alias("all"), *wanted).first()

    def answer(limit: int, found: Row | None) -> int:
        return (row["all"] or 0) if found is None else found.tokens_up_to - found.tokens + limit * found.docs_at_least

    return {limit: answer(limit, row[str(i)]) for i, limit in enumerate(limits)}


def quantiles(sums: DataFrame, shares: list[float]) -> dict[float, int | None]:
    """The smallest length that the share of the documents does not exceed; null over no documents."""
    total = sums.agg(F.max("all_docs")).first()[0]
    if total is None:
        return dict.fromkeys(shares)
    row = sums.agg(*[F.min(F.when(F.col("docs_up_to") >= max(1, math.ceil(q * total)), F.col("n_tokens"))).alias(str(i)) for i, q in enumerate(shares)]).first()
    return {q: row[str(i)] for i, q in enumerate(shares)}
