"""Ordered operators (F*), sorts and top-k (G*), set operations (H*).

Keep-first, keep-last and top-k per key are written as a rank with a bound. Spark then keeps at
most k rows per key and map task before the shuffle, so a key that holds a large share of the rows
does not travel to one task. Positions inside a group use counts per bucket (`position_in_group`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltion.functions.numbers import parse_locale_number
from deltion.functions.text import clean, let, lines, norm_text

Order = Column | Sequence[Column]


def _list(x) -> list:
    return [x] if isinstance(x, (str, Column)) else list(x)


def top_per_key(df: DataFrame, keys, order: Order, k: int = 1, rank: str | None = None) -> DataFrame:
    """First k rows of each key in the given order; `rank` names a column for the position."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*_list(keys)).orderBy(*_list(order))))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def latest_per_key(df: DataFrame, keys, seq: str) -> DataFrame:
    """newest row per key."""
    return top_per_key(df, keys, F.col(seq).desc_nulls_last())


def prefer_then_latest(df: DataFrame, keys, preferred: Column, seq: str) -> DataFrame:
    """preferred rows first (already downloaded), then the newest."""
    return top_per_key(df, keys, [F.coalesce(preferred, F.lit(False)).desc(), F.col(seq).desc_nulls_last()])


def first_wins(df: DataFrame, keys, seq: str) -> DataFrame:
    """first row per official key; never by title."""
    return top_per_key(df, keys, F.col(seq).asc_nulls_last())


def last_wins(df: DataFrame, keys, seq: str) -> DataFrame:
    """F8: last row per key."""
    return latest_per_key(df, keys, seq)


def position_in_group(df: DataFrame, keys, order: Order, bucket: Column, name: str = "position", start: int = 0) -> DataFrame:
    """position of a row in its group without sorting a whole group in one task.

    `bucket` must not decrease along the order. Rows are numbered inside (key, bucket); the rows
    in earlier buckets of the key, counted map-side, are added.
    """
    keys = _list(keys)
    df = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*_list(order)))
    return (
        df.withColumn("_inside", inside).join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_inside") - 1 + start)
        .drop("_bucket", "_inside", "_offset")
    )


def document_rank(name: Column, document_type: Column, has_links: Column) -> Column:
    """declaration, offer, document with linked ids, other."""
    plain, kind = norm_text(F.coalesce(name, F.lit(""))), norm_text(F.coalesce(document_type, F.lit("")))
    return let(F.struct(plain.alias("name"), kind.alias("kind")), lambda t: (
        F.when(t["name"].contains("διακηρυ") | t["kind"].contains("declaration"), 0)
        .when(t["name"].contains("οικονομικ") | t["name"].contains("προσφορ"), 1)
        .when(has_links, 2).otherwise(3)
    ))


def top_evidence(df: DataFrame, key: str, name: str, rank: Column, k: int) -> DataFrame:
    """the k best documents of each row, by rank then name."""
    return top_per_key(df.withColumn("evidence_rank", rank), key, [F.col("evidence_rank"), norm_text(F.col(name)), F.col(name)], k, rank="position")


def best_deadline(df: DataFrame, key: str) -> DataFrame:
    """latest deadline statement per row, then an extension, then the surer one."""
    best = F.max(F.struct("deadline_key", "is_extension", "confidence", "deadline_at")).alias("_b")
    return df.filter(F.col("deadline_key") != "9999").groupBy(key).agg(best).select(
        key, F.col("_b.deadline_at").alias("deadline_at"), F.col("_b.is_extension").alias("is_extension"), F.col("_b.confidence").alias("confidence")
    )


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm_text(text, underscores=True), " "), lambda w: w != ""))


def dedupe_similar(matches: Column, threshold: float = 0.70) -> Column:
    """greedy removal of near-equal evidence inside one document's array of matches.

    `matches`: array<struct<match_type, term, confidence, context, ...>> in the order found. A match
    whose context shares at least `threshold` of the smaller word set with an earlier one of its type
    is dropped, or takes that one's place when it has higher confidence or a longer term.
    """
    with_words = F.transform(matches, lambda m: F.struct(m.alias("m"), words(m["context"]).alias("w")))

    def similar(a: Column, b: Column) -> Column:
        smaller = F.least(F.size(a["w"]), F.size(b["w"]))
        share = F.size(F.array_intersect(a["w"], b["w"])) / F.when(smaller > 0, smaller)
        return (a["m"]["match_type"] == b["m"]["match_type"]) & F.coalesce(share >= threshold, F.lit(False))

    def rank(x: Column) -> Column:
        return F.struct(x["m"]["confidence"], F.length(x["m"]["term"]))

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda y: similar(y, x)), F.lit(True))
        better = rank(x) > rank(F.try_element_at(kept, F.when(at > 0, at.cast("int"))))
        replaced = F.transform(kept, lambda y, i: F.when(i + 1 == at, x).otherwise(y))
        return F.when(at == 0, F.concat(kept, F.array(x))).when(better, replaced).otherwise(kept)

    kept = F.aggregate(with_words, F.slice(with_words, 1, 0), step)
    return F.transform(kept, lambda x: x["m"])


def line_context(text: Column, reach: int = 3) -> Column:
    """non-blank lines with their neighbours: array<struct<idx, line, before, after>>."""
    return let(
        F.filter(lines(text), lambda x: F.length(F.trim(x)) > 0),
        lambda kept: F.transform(
            kept,
            lambda x, i: F.struct(
                i.alias("idx"), F.rtrim(x).alias("line"),
                F.slice(kept, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))).alias("before"),
                F.slice(kept, i + 2, reach).alias("after"),
            ),
        ),
    )


def fill_marker(markers: Column) -> Column:
    """row numbers of lines whose marker is a number or `~` (previous number + 1).

    array<string> -> array<int>; null where no number precedes a `~`.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("int").alias("last"))

    def step(acc: Column, m: Column) -> Column:
        number = F.when(m == "~", acc["last"] + 1).otherwise(m.try_cast("int"))
        return F.struct(F.concat(acc["out"], F.array(number)).alias("out"), F.coalesce(number, acc["last"]).alias("last"))

    return F.aggregate(markers, start, step, lambda acc: acc["out"])


def fill_marker_rows(df: DataFrame, keys, order: Order, marker: str, bucket: Column, name: str = "number") -> DataFrame:
    """the same over rows of a group: a row marked `~` has the last number before it plus the `~` since.

    `bucket` must not decrease along the order and bounds what one window holds. A bucket hands on its last number, with the
    `~` after it, to the buckets behind it; these are one row each. Other marks have no number and change nothing.
    """
    keys = _list(keys)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*_list(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stated, steps = F.col(marker).try_cast("int"), F.count_if(F.coalesce(F.col(marker) == "~", F.lit(False))).over(inside)
    rows = df.withColumn("_bucket", bucket).withColumn("_steps", steps)
    # A number less the steps before it: added to the steps at a later row, it gives that row's number.
    rows = rows.withColumn("_base", F.last(stated - F.col("_steps"), ignorenulls=True).over(inside))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max("_steps").alias("_n"), F.max(F.struct(*_list(order), F.col("_base").alias("_base"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_sum", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = F.last(F.col("_end._base") - F.col("_sum"), ignorenulls=True).over(before)
    ends = ends.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bucket").alias("_at"), (carried + F.col("_sum")).alias("_carried"))
    same = F.col("_bucket") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = rows.join(ends, same, "left")
    number = F.when(F.col(marker) == "~", F.coalesce("_base", "_carried") + F.col("_steps")).otherwise(stated)
    return out.select(*df.columns, number.cast("int").alias(name))


def latest_run(df: DataFrame, seq: str, success: Column | None = None) -> DataFrame:
    """the latest run, or the latest successful one."""
    if success is not None:
        df = df.filter(success)
    return df.orderBy(F.col(seq).desc_nulls_last()).limit(1)


def text_windows(text: Column, score, size: int = 36, k: int = 3, snippet: int = 900) -> Column:
    """blocks of `size` lines with a positive score, best k: array<struct<score, line_start, snippet>>.

    `score` is a function of the cleaned block.
    """
    def cut(rows: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(rows) - 1, F.lit(size))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), clean(F.array_join(F.slice(rows, s + 1, size), "\n")).alias("block")))

    blocks = let(lines(text), cut)
    scored = F.transform(blocks, lambda b: F.struct((-score(b["block"])).alias("neg"), (b["start"] + 1).alias("line_start"), b["block"].alias("block")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["neg"] < 0)), 1, k)
    return F.transform(best, lambda s: F.struct((-s["neg"]).alias("score"), s["line_start"].alias("line_start"), F.substring(s["block"], 1, snippet).alias("snippet")))


def unique_names(df: DataFrame, folder: str, name: str, order: str, bucket: Column) -> DataFrame:
    """F16: the second file of a name in a folder gets `_2`, the third `_3`, ..."""
    numbered = position_in_group(df, [folder, name], F.col(order), bucket, "_n", start=1)
    stem = F.regexp_replace(F.col(name), r"(.)(\.[^.]*)$", "$1")
    suffix = F.regexp_extract(F.col(name), r".(\.[^.]*)$", 1)
    unique = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), suffix))
    return numbered.withColumn("unique_name", unique).drop("_n")


def prefix_until_exhausted(df: DataFrame, org: str, page: str, outside: Column) -> DataFrame:
    """items of the pages read before paging stops: up to and including the first page
    whose items all lie outside the window."""
    pages = df.groupBy(org, page).agg(F.bool_and(outside).alias("_all"))
    stop = pages.groupBy(org).agg(F.min(F.when(F.col("_all"), F.col(page))).alias("_stop"))
    return df.join(stop, org).filter(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop")


def marker_unit_prices(text: Column, reach: int = 80) -> Column:
    """price stated between a section marker `A.T.: n` and the next one: map<int, decimal>."""
    mark = r"(?iu)\b[AΑ]\.?\s*[TΤ]\.?\s*:\s*(\d{1,9})\b"

    def read(rows: Column, markers: Column) -> Column:
        last = F.least(F.size(rows), F.try_element_at(markers, F.lit(-1))["at"] + reach)

        def price(m: Column, j: Column) -> Column:
            end = F.coalesce(F.try_element_at(markers, (j + 2).cast("int"))["at"], last)
            block = F.array_join(F.slice(rows, m["at"] + 1, end - m["at"]), "\n")
            stated = F.regexp_extract(block, r"(?iu)\(Αριθμητικώς\)\s*:\s*(\d+(?:[.,]\d{1,3})*)", 1)
            return F.struct(m["n"].cast("int").alias("key"), parse_locale_number(stated).alias("value"))

        return F.filter(F.transform(markers, price), lambda p: p["value"].isNotNull())

    def markers_of(rows: Column) -> Column:
        numbered = F.transform(rows, lambda x, i: F.struct(i.alias("at"), F.when(x.contains(":"), F.regexp_extract(x, mark, 1)).otherwise("").alias("n")))
        return F.filter(numbered, lambda m: m["n"] != "")

    def last_of_each(priced: Column) -> Column:
        keys = F.transform(priced, lambda p: p["key"])
        return F.filter(priced, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))

    none = F.map_from_entries(F.array().cast("array<struct<key:int,value:decimal(24,6)>>"))
    priced = let(let(lines(text), lambda rows: let(markers_of(rows), lambda m: read(rows, m))), last_of_each)
    # No marker without a colon; the lines are searched once, not the whole text before them.
    return F.when(text.contains(":"), F.map_from_entries(priced)).otherwise(none)


# --- sorts and top-k -------------------------------------------------------------------------


def sort_rows(df: DataFrame, mode: str = "deadline_asc", budget="budget", deadline="deadline_sort", key="display_id") -> DataFrame:
    """G1: by deadline, or by budget from high to low with missing budgets last."""
    by_deadline = [F.coalesce(F.col(deadline), F.lit("9999")).asc(), F.coalesce(F.col(key), F.lit("")).asc()]
    if mode == "budget_desc":
        return df.orderBy(F.col(budget).isNull().asc(), F.col(budget).desc(), *by_deadline)
    return df.orderBy(*by_deadline)


def sort_hidden(df: DataFrame, at: str = "audit_at", priority: str | None = None) -> DataFrame:
    """Newest first, rows without a time last; with `priority`, HIGH before MEDIUM before LOW."""
    order = [(F.coalesce(F.col(at), F.lit("")) != "").desc(), F.col(at).desc(), F.col("display_id").desc(), F.col("row_key").desc()]
    if priority:
        order.insert(0, F.when(F.col(priority) == "HIGH", 3).when(F.col(priority) == "MEDIUM", 2).when(F.col(priority) == "LOW", 1).otherwise(0).desc())
    return df.orderBy(*order)


def problem_sources(df: DataFrame, k: int) -> DataFrame:
    """Sources with an error or poor health, errors first, by id."""
    error = (F.coalesce("last_error", F.lit("")) != "") | (F.coalesce("last_status", F.lit("")) == "ERROR")
    poor = F.coalesce(F.col("health_status").isin("WATCH", "DEGRADED", "DISABLE_CANDIDATE"), F.lit(False))
    return df.filter(error | poor).orderBy(error.desc(), F.col("source_id")).limit(k)


ATTENTION = ["Λήγουν σύντομα", "Χωρίς έγγραφα", "Χωρίς ΕΣΗΔΗΣ", "Υψηλότεροι προϋπολογισμοί"]


def attention_buckets(df: DataFrame, days_left: Column, has_documents: Column, has_registry_id: Column, budget: Column, key: str,
                      groups: Sequence[str], top: int) -> DataFrame:
    """Rows that need attention, one row per (bucket, row): expiring within a week, without
    documents, without a registry id, and the highest budgets (per group of `groups`)."""
    tests = [days_left.between(0, 7), ~has_documents, ~has_registry_id]
    flags = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in zip(tests, ATTENTION)]))
    marked = df.select("*", F.explode(flags).alias("bucket"))
    priced = df.filter(budget.isNotNull())
    order = [budget.desc(), F.col(key).asc()]
    high = top_per_key(priced, list(groups), order, top) if groups else priced.orderBy(*order).limit(top)
    return marked.unionByName(high.withColumn("bucket", F.lit(ATTENTION[3])))


def nested_topk(df: DataFrame, row_key: str, row_order: Order, match_order: Order, rows: int, matches: int) -> DataFrame:
    """At most `matches` matches of each of the first `rows` rows."""
    best = top_per_key(df, row_key, match_order, matches, rank="match_rank")
    heads = df.select(row_key, *[c for c in _names(row_order) if c != row_key]).distinct().orderBy(*_list(row_order)).limit(rows)
    return best.join(heads.select(row_key), row_key, "left_semi")


def _names(order: Order) -> list[str]:
    return [o for o in _list(order) if isinstance(o, str)]


def order_candidates(df: DataFrame, key: str, deadline: Column, seq: str) -> DataFrame:
    """First candidate of each id, by deadline (unparsable last), then id."""
    return first_wins(df, key, seq).orderBy(deadline.asc_nulls_last(), F.col(key))


def two_stage_topk(df: DataFrame, project: str, name: str, light: Column, full: Column, priority: Column, k: int) -> DataFrame:
    """Cheap score keeps 2k documents per project, the full score orders them, k remain."""
    short = top_per_key(df.withColumn("light_score", light), project, [F.col("light_score").desc(), F.col(name)], 2 * k)
    scored = short.withColumn("score", full).withColumn("priority", priority).filter("score > 0")
    return top_per_key(scored, project, [F.col("priority").desc(), F.col("score").desc(), F.col(name)], k, rank="position")


def guard_route(route: DataFrame, candidates: DataFrame, project: str) -> DataFrame:
    """Replace a routed document by the best stand-alone official one unless it is one itself.

    route (project, document_id, confidence); candidates (project, document_id, document_name, priority, score).
    """
    official = candidates.filter("priority > 0")
    best = top_per_key(official, project, [F.col("priority").desc(), F.col("score").desc(), F.col("document_name")])
    chosen = official.filter(~F.translate("document_name", "\\", "/").contains("/")).select(project, "document_id", F.lit(True).alias("_official"))
    joined = route.join(chosen, [project, "document_id"], "left").join(
        best.select(project, F.col("document_id").alias("_best")), project, "left"
    )
    override = F.col("_best").isNotNull() & F.col("_official").isNull() & ~F.col("document_id").eqNullSafe(F.col("_best"))
    return joined.select(
        project,
        F.when(override, F.col("_best")).otherwise(F.col("document_id")).alias("document_id"),
        F.when(override, F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.8))).otherwise(F.col("confidence")).alias("confidence"),
        override.alias("overridden"),
    )


def list_recent(df: DataFrame, day: str, fetched: str, key: str, cutoff: Column) -> DataFrame:
    """Visible records inside the window, newest first."""
    inside = (F.col("status") == "VISIBLE") & (F.col(day).isNull() | (F.col(day) >= cutoff))
    return df.filter(inside).orderBy(F.col(day).desc_nulls_last(), F.col(fetched).desc_nulls_last(), F.col(key))


def list_archived(df: DataFrame, archived_at: str, day: str, key: str, limit: int) -> DataFrame:
    """Latest archived records."""
    return df.filter(F.col("status") == "ARCHIVED").orderBy(F.col(archived_at).desc_nulls_last(), F.col(day).desc_nulls_last(), F.col(key)).limit(limit)


# --- sets ------------------------------------------------------------------------------------


def union_sources(*dfs: DataFrame) -> DataFrame:
    """H1: producers with different columns into one schema (keeps duplicates)."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def id_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """H2: distinct ids in both."""
    return a.intersect(b)


def id_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """H3: distinct ids of `a` that are not in `b`."""
    return a.subtract(b)


def id_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """H4: distinct ids of either."""
    return a.union(b).distinct()


def is_subset(inner: Column, outer: Column) -> Column:
    """H5: every element of `inner` is in `outer`."""
    return F.size(F.array_except(inner, outer)) == 0


def subset_by_group(df: DataFrame, key: str, value: str, allowed: DataFrame) -> DataFrame:
    """H5: groups all of whose values are allowed, without collecting a group."""
    flagged = df.join(allowed.select(value).distinct().withColumn("_ok", F.lit(True)), value, "left")
    return flagged.groupBy(key).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("is_subset"), F.count(F.lit(1)).alias("n"))

