"""Mixing sources to target weights: equal-token blocks by Sainte-Laguë apportionment.

Targets come from the weights of the sources, filled up to a bound of repeats. Blocks of (nearly) equal numbers of words go
to the sources by highest quotients; the quota of a source goes on to its sections and theirs to their shards in the same
way, so every shard has an integer quota. A shard then takes its blocks by a seeded hash; the documents lie in a
shard in a seeded order, so a block may run over several of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltion.llm.shared import numbered, settle

WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], max_repeats: int) -> DataFrame:
    """From (source, size), one row each: its number `sid` by code point (null last), its weight and its target.

    The targets share the sum of all sizes by weight. A target stops at `max_repeats` times the size of its source; what is
    over goes to the others by weight, until none is above. A round of that is one aggregate of one row; a source that
    stopped never opens again, so there are at most as many rounds as sources, and in practice a few.
    """
    named = numbered(sizes.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "sid").drop("_last")
    weight = F.get(F.array(*map(F.lit, weights)), F.col("sid") % len(weights)).cast("long")
    rows = settle(named.withColumn("weight", weight).withColumn("most", F.col("size") * max_repeats), "mix-sources")
    level, before = 0.0, None
    while level != before:
        stopped = F.col("most") <= F.col("weight") * F.lit(level)
        one = rows.agg(F.sum("size").alias("all"), F.sum(F.when(stopped, F.col("most"))).alias("stopped"), F.sum(F.when(~stopped, F.col("weight"))).alias("open")).first()
        before, level = level, ((one["all"] or 0) - (one.stopped or 0)) / one.open if one.open else level
    return rows.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))).drop("most")


def apportion(rows: DataFrame, group: list[str], weight: str, seats: str, tie: str, name: str) -> DataFrame:
    """Sainte-Laguë: `seats` (one number for each group) go to the rows with the highest weight / (2k + 1), ties to the smaller `tie`.

    With W the weights, N the seats and S the rows of a group, the divisor lies between W / (N + S/2) and W / (N - S/2):
    a share rounded under the one gives too many seats, under the other too few. So all seats but at most 2 S + 2 are
    known from two divisions, and only these are ranked. Groups are sources, sections or shards, never documents.
    """
    of = Window.partitionBy(*(group or [F.lit(0)]))
    all_, n = F.sum(weight).over(of), F.count(F.lit(1)).over(of)
    share = lambda s: F.coalesce(F.floor(F.col(weight) * s / F.when(F.col("_all") > 0, F.col("_all")) + 0.5), F.lit(0)).cast("long")
    rows = rows.withColumn("_all", all_.cast("double")).withColumn("_n", n)
    low, high = F.col(seats) - F.col("_n") / 2 - 1, F.col(seats) + F.col("_n") / 2 + 1
    rows = rows.withColumn("_low", F.when(low > 0, share(low)).otherwise(F.lit(0).cast("long"))).withColumn("_high", share(high))
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_low").over(of))
    tries = F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1))
    ranked = rows.select("*", F.explode_outer(tries).alias("_k"))
    place = F.row_number().over(of.orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc_nulls_last(), tie))
    taken = F.count(F.when((F.col("_place") <= F.col("_left")) & F.col("_k").isNotNull(), 1))
    keep = [c for c in rows.columns if not c.startswith("_")]
    return ranked.withColumn("_place", place).groupBy(*keep, "_low").agg(taken.alias("_more")).select(*keep, (F.col("_low") + F.col("_more")).alias(name))


def block_hash(seed: str, block: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("sid"), F.col("shard"), block))


def mix(docs: DataFrame, weights: list[int], id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", block_words: int = 32, max_repeats: int = 3, shard_words: int = 1 << 16, shards_per_section: int = 1024, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, digest (md5 of the text), size (words), source_size, target, sid, section, shard,
    spans (block, first word in the document, words, times) of the blocks that are taken, taken (sum of words x times).

    A null text has no words; a null source is a source and comes last; documents without words take nothing; an
    empty table gives no rows. Rows that are equal in id, source and text are told apart by number only: a run of copies
    is dealt to shards in pieces of at most a quarter of a shard, so they never gather. A shard has about `shard_words`
    words (its documents fall there by hash), or one document if that is longer. A quota beyond `max_repeats` of all
    blocks of a shard stops there, so no word is taken more often. Results depend on the rows and the seed alone.
    """
    fields = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.col(text_column).alias("text"))
    rows = settle(fields.select("doc_id", "source", F.md5("text").alias("digest"), count_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "digest", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-rows")
    sources = settle(source_targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")), weights, max_repeats), "mix-targets")
    known = sources.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "sid", "target")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    per_unit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(shard_words // 4) / F.when(F.col("size") > 0, F.col("size")).otherwise(1)))
    units = rows.withColumn("_unit", per_unit).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / F.col("_unit")))).alias("piece"))
    units = units.withColumn("copies", F.least("_unit", F.col("copies") - F.col("piece") * F.col("_unit"))).drop("_unit")
    place = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "sid", F.coalesce("digest", F.lit("-")), "piece"))
    shards = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words))
    units = units.withColumn("place", place).withColumn("shard", F.conv(F.substring("place", 1, 12), 16, 10).cast("long") % shards)
    units = settle(units.withColumn("section", F.floor(F.col("shard") / shards_per_section)), "mix-units")

    blocks = F.greatest(F.lit(1).cast("long"), F.floor((2 * F.col("words") + block_words) / (2 * block_words)))
    shards = settle(units.where("size > 0").groupBy("sid", "section", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).withColumn("blocks", blocks), "mix-shards")
    total = sources.agg(F.floor(F.sum("size") / block_words + F.lit(0.5)).cast("long").alias("n")).first().n or 0
    quota = settle(apportion(sources.select("sid", "target").withColumn("seats", F.lit(total)), [], "target", "seats", "sid", "quota").select("sid", "quota"), "mix-quota")
    sections = shards.groupBy("sid", "section").agg(F.sum("words").alias("words")).join(quota, "sid")
    sections = settle(apportion(sections, ["sid"], "words", "quota", "section", "section_quota").select("sid", "section", "section_quota"), "mix-sections")
    shards = apportion(shards.join(sections, ["sid", "section"]), ["sid", "section"], "words", "section_quota", "shard", "quota")
    shards = shards.withColumn("quota", F.least("quota", F.col("blocks") * max_repeats))
    rest = F.col("quota") % F.col("blocks")
    hashes = F.sort_array(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: block_hash(seed, j)))
    shards = settle(shards.select("sid", "section", "shard", "words", "blocks", F.floor(F.col("quota") / F.col("blocks")).alias("rounds"), F.when(rest > 0, F.get(hashes, rest - 1)).alias("last_hash")), "mix-shard-quotas")

    before = F.sum(F.col("size") * F.col("copies")).over(Window.partitionBy("sid", "section", "shard").orderBy("place", "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1))
    laid = units.where("size > 0").withColumn("start", F.coalesce(before, F.lit(0).cast("long"))).join(shards, ["sid", "section", "shard"])
    copies = laid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("_copy"))
    copies = copies.withColumn("start", F.col("start") + F.col("_copy") * F.col("size")).withColumn("end", F.col("start") + F.col("size"))
    at = lambda w: F.expr(f"(({w} + 1) * blocks - 1) div words")
    edge = lambda j: F.call_function("div", j * F.col("words"), F.col("blocks"))
    span = lambda j: F.struct(
        j.alias("block"), (F.greatest(F.col("start"), edge(j)) - F.col("start")).alias("first"), (F.least(F.col("end"), edge(j + 1)) - F.greatest(F.col("start"), edge(j))).alias("words"),
        (F.col("rounds") + F.coalesce((block_hash(seed, j) <= F.col("last_hash")).cast("long"), F.lit(0))).alias("times"),
    )
    copies = copies.withColumn("spans", F.filter(F.transform(F.sequence(at("start"), at("end - 1")), span), lambda s: s["times"] > 0))
    out = ["doc_id", "source", "digest", "size", "source_size", "target", "sid", "section", "shard"]
    empty = units.where("size = 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    chosen = copies.select(*out, "spans").unionByName(empty.select(*out), allowMissingColumns=True)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"] * s["times"])
    return chosen.withColumn("taken", F.coalesce(taken, F.lit(0).cast("long")))


def block_texts(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The mix itself: (sid, shard, block, first, times, doc_id, text), a row for each document that a taken block runs over.

    The words of a span are joined by single spaces. Equal rows of `docs` count as one text; their spans come from each copy.
    """
    fields = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.col(text_column).alias("text"))
    texts = fields.withColumn("digest", F.md5("text")).dropDuplicates(["doc_id", "source", "digest"]).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("digest").alias("_digest"), "text")
    spans = mixed.select("doc_id", "source", "digest", "sid", "shard", F.explode("spans").alias("s"))
    rows = spans.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("digest") == F.col("_digest")))
    words = F.regexp_extract_all("text", F.lit(WORD), 0)
    return rows.select("sid", "shard", "s.block", "s.first", "s.times", "doc_id", F.array_join(F.slice(words, (F.col("s.first") + 1).cast("int"), F.col("s.words").cast("int")), " ").alias("text"))
