"""Quality rules with host verdicts, in DataFrame functions only.

Every document is counted and judged by the base rules in one narrow step. The failures are summed by host, the rates
of small hosts are shrunk towards the mean with a beta prior fitted to all hosts by moments, and the verdict on a host is
joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltion.llm.shared import settle

# Fixed values of the rules.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def text_counters(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (see `judge`) to the rows.

    Windows of three words are compared by a 64-bit hash within the text. Only texts in which one comes back are
    sorted by it. The steps are separate columns, so nothing is computed twice; all stays in the row, without a shuffle.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    keep = docs.columns
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, BLANKS, "") != "")
    spaced = F.translate(text, BLANKS, " " * len(BLANKS))
    rows = docs.withColumns({"_lines": lines, "_words": F.array_remove(F.split(spaced, " ", -1), ""), "_chars": F.length(F.translate(text, BLANKS, "")), "_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, ""))})
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("_windows", F.when(F.size("_hashes") > 3, F.transform(F.slice("_hashes", F.lit(1), F.size("_hashes") - 2), lambda h, i: F.xxhash64(h, F.get("_hashes", i + 1), F.get("_hashes", i + 2)))))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.expr("filter(_sorted, (x, k) -> get(_sorted, k - 1).h <=> x.h or get(_sorted, k + 1).h <=> x.h)")
    rows = rows.withColumn("_starts", F.transform(twice, lambda x: x["i"]))
    covered = F.size(F.array_distinct(F.concat(F.col("_starts"), F.transform("_starts", lambda i: i + 1), F.transform("_starts", lambda i: i + 2))))
    return rows.select(
        *keep, F.size("_words").cast("long").alias("n_words"), F.col("_chars").cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.when(F.col("_starts").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(judged: DataFrame, host_column: str, reject_rate: float) -> DataFrame:
    """One row per host: host_docs, host_failures, host_rate (shrunk) and host_kept.

    The prior has the mean of all documents and the variance of the host rates, weighted by documents, less what a host
    of that size varies by chance; its weight stays between 1 and 1 000 000 documents. A null host is a host.
    """
    hosts = judged.groupBy(host_column).agg(F.count(F.lit(1)).alias("host_docs"), F.count(F.when(F.col("base_failed"), 1)).alias("host_failures"))
    share = F.col("host_failures") / F.col("host_docs")
    one = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failures").alias("f"), F.sum(share * F.col("host_failures")).alias("ff"), F.count(F.lit(1)).alias("hosts")).first()
    mean = one.f / one.n if one.n else 0.0
    spread = one.ff / one.n - mean * mean if one.n else 0.0
    chance = mean * (1 - mean) * one.hosts / one.n if one.n else 0.0
    real = spread - chance
    weight = min(max(mean * (1 - mean) / real - 1, 1.0), 1e6) if real > 0 else 1e6
    rate = F.round((F.col("host_failures") + mean * weight) / (F.col("host_docs") + weight), 6)
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= reject_rate)


def judge(docs: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text", min_words: int = 50, max_repeat_percent: int = 50, reject_rate: float = 0.5) -> DataFrame:
    """Base rules and host verdicts for every document.

    Words are runs of other characters than blank, tab and line ends; n_repeat_words counts the words in windows of three
    that are found twice or more in the text. base_failed: fewer than `min_words` words, or more than
    `max_repeat_percent` of them repeated. kept: not base_failed, and the shrunk failure rate of the host is at most
    `reject_rate`. Null and empty texts have no words and fail; repeated rows and null ids are kept as they are; documents
    without a host share one; an empty table gives no rows.

    The counters are written once; only they, not the texts, are gathered by host (partial sums) and joined back
    (an equi-join that adaptive execution splits where one host has many documents).
    """
    rows = text_counters(docs.select(F.col(id_column).alias("_id"), F.col(host_column).alias("_host"), F.col(text_column).alias("_text")), "_text").drop("_text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = settle(rows.withColumn("base_failed", failed), "host-quality")
    hosts = host_verdicts(rows, "_host", reject_rate).withColumnRenamed("_host", "_host_of")
    joined = rows.join(hosts, rows["_host"].eqNullSafe(hosts["_host_of"]))
    return joined.select(
        F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
        F.col("_host").alias("host"), "host_docs", "host_failures", "host_rate",
    )
