"""Removal of bytes that an earlier place already holds in a run of `length` bytes, exactly.

Two equal windows of `length` bytes have the same smallest gram, by a hash, at the same place in the window. So every
document is cut into runs of windows with the same anchor gram, and only runs with equal anchors can hold equal windows.
A run and the bytes it needs are its context. Of equal contexts all but the first go at once, in each task before the
shuffle and over all after it. Contexts that differ but share an anchor are put into shards; the suffix array of a shard
and its common prefixes find the equal windows among them. An anchor with very many contexts is settled window by window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion.llm.shared import free_name, lean, settle
from deltion.llm.suffix_array import common_prefixes, suffix_array

GRAM = 24
NO_ID = (1 << 63) - 1  # a null id comes after all others
PIECE = 2_000_000  # bytes of a document that are hashed at a time
COMBINED = 200_000  # runs among which equal contexts are settled before the shuffle
SHARD = 1_000_000  # bytes of contexts in one suffix array
WIDE = 4096  # contexts of one anchor from which on windows are settled one by one
SAMPLE_DOCS = 4000  # documents in which frequent anchors are looked for; they only decide how rows are dealt

RUN = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("span", pa.int64())])
RUN_FIELDS = "gram long, context long, doc long, version long, span long"
# span: start * 2^13 + size * 2 + 1 where the anchor is known to be frequent; size 0 marks bytes that are settled, in (gram, context) = (from, to).


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


TABLE, FACTORS = _odd(256, 11) ^ np.uint64(0x5555), _odd(16, 12)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size` bytes in a row, built from hashes of half the size."""
    mix = lambda h: h ^ (h >> np.uint64(29))
    whole, done, part, width, level = None, 0, TABLE[data], 1, 0
    while width <= size:
        if size & width:
            end = len(data) - size + 1
            piece = part[size - done - width : size - done - width + end]
            whole = piece.copy() if whole is None else mix(whole * FACTORS[15] + piece)
            done += width
        if 2 * width <= size:
            part = mix(part[:-width] * FACTORS[level] + part[width:])
        width, level = 2 * width, level + 1
    whole = whole * np.uint64(0x9E3779B97F4A7C15)
    return whole ^ (whole >> np.uint64(32))


def runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of the runs of windows that share their smallest gram, of a whole text."""
    window, parts = length - gram + 1, []
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        hashes = gram_hashes(np.frombuffer(data, np.uint8, min(len(data) - at, PIECE + length - 1), at), gram)
        key = (hashes & ~np.uint64(0x3FFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            key, width = np.minimum(key[:-width], key[width:]), 2 * width
        if width < window:
            key = np.minimum(key[: len(key) - (window - width)], key[window - width :])
        place = (key & np.uint64(0x3FFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parts.append((hashes[place[first]].view(np.int64), first + at, np.append(first[1:], len(place)) - 1 + at))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals of a union; touching ones are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], np.append(reach[:-1][new[1:]], reach[-1])


def _batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _settled(doc: np.ndarray, version: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Removed bytes as merged intervals of each document: doc, version, start, end."""
    if not len(doc):
        return doc, version, start, end
    order = np.lexsort((start, version, doc))
    doc, version, start, end = doc[order], version[order], start[order], end[order]
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])]))
    out = [(np.full(len(s), doc[a]), np.full(len(s), version[a]), s, e) for a, z in zip(cuts, np.append(cuts[1:], len(doc)), strict=True) for s, e in [merged(start[a:z], end[a:z])]]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first_of_equal(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of rows sorted by keys, doc and start: True for those at the first place of their keys."""
    new = np.zeros(len(doc), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    return (doc == doc[head]) & (start == start[head])


def document_runs(docs: DataFrame, length: int, frequent: frozenset[int]) -> DataFrame:
    """Runs of all documents, without those whose context a task has seen shortly before, which are settled."""
    import xxhash

    def work(batches):
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            held, last_row = 0, batch.num_rows - 1
            for row, (doc, version, text) in enumerate(zip(*batch.columns, strict=True)):
                data = text.as_py().encode()
                gram, first, last = runs(data, length, GRAM)
                context = np.array([xxhash.xxh3_64_intdigest(data[a:z]) for a, z in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64).view(np.int64)
                hot = np.isin(gram, hot_grams)
                for column, values in zip(columns, (gram, context, np.full(len(gram), doc.as_py()), np.full(len(gram), version.as_py()), first << 13 | (last - first + length) << 1 | hot), strict=True):
                    column.append(values)
                held += len(gram)
                if held >= COMBINED or row == last_row and held:
                    yield from combined(*(np.concatenate(c) for c in columns))
                    columns, held = [[] for _ in range(5)], 0

    def combined(gram, context, doc, version, span):
        order = np.lexsort((span, doc, context, gram))
        gram, context, doc, version, span = (x[order] for x in (gram, context, doc, version, span))
        start = span >> 13
        keep = _first_of_equal((gram, context), doc, start)
        yield _batch(RUN, *(x[keep] for x in (gram, context, doc, version, span)))
        gone = ~keep
        if gone.any():
            d, v, s, e = _settled(doc[gone], version[gone], start[gone], start[gone] + (span[gone] >> 1 & 4095))
            yield _batch(RUN, s, e, d, v, np.zeros(len(d), np.int64))

    hot_grams = np.array(sorted(frequent), np.int64)
    return docs.mapInArrow(lean(work), RUN_FIELDS)


def frequent_grams(docs: DataFrame, length: int) -> frozenset[int]:
    """Anchors of at least a hundredth of a sample of documents, with different contexts; a bounded number.

    Their runs are dealt by context too. Missing one here changes how even the tasks are, not the result.
    """
    total = docs.count()
    least = max(20, SAMPLE_DOCS // 100)

    def work(batches):
        for batch in batches:
            for text in batch.column(0):
                data = text.as_py().encode()
                gram, _, _ = runs(data, length, GRAM)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(gram), pa.int64())], names=["gram"])

    if total < least:
        return frozenset()
    sample = docs if total <= SAMPLE_DOCS else docs.sample(fraction=SAMPLE_DOCS / total, seed=5)
    found = sample.select("text").mapInArrow(lean(work), "gram long").groupBy("gram").count().where(F.col("count") >= least).select("gram").collect()
    return frozenset(r.gram for r in found)


FOUND = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("gram", pa.int64())])
FOUND_FIELDS = "doc long, version long, start long, end long, gram long"


def compare_runs(rows: DataFrame) -> DataFrame:
    """Settle equal contexts; leave those that share an anchor and differ, or may do so, to a closer look (gram not null).

    A task streams through its anchors in order. It holds the contexts of one anchor, WIDE of them at most.
    """

    def out(doc, version, start, end, gram=None):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, version, start, end)] + [pa.nulls(len(doc), pa.int64()) if gram is None else pa.array(gram, pa.int64())], schema=FOUND)

    def work(batches):
        at, context_at, owner = None, None, (0, 0)  # anchor and context that the last batch ended in, and its first place
        held: list[tuple[np.ndarray, ...]] = []  # doc, version, span of the contexts of that anchor
        contexts = 0

        def closer(parts, contexts):
            doc, version, span = (np.concatenate(x) for x in zip(*parts, strict=True))
            if contexts > 1 or (span & 1).any():
                yield out(doc, version, span >> 13, (span >> 13) + (span >> 1 & 4095), np.full(len(doc), at))

        for batch in batches:
            gram, context, doc, version, span = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            done = span == 0
            if done.any():
                yield out(doc[done], version[done], gram[done], context[done])
                gram, context, doc, version, span = (x[~done] for x in (gram, context, doc, version, span))
            if not len(gram):
                continue
            start = span >> 13
            end = start + (span >> 1 & 4095)
            new_gram = np.concatenate([[gram[0] != at], gram[1:] != gram[:-1]])
            new = new_gram | np.concatenate([[context[0] != context_at], context[1:] != context[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
            first_doc = np.where(head < 0, owner[0], doc[head])
            first_start = np.where(head < 0, owner[1], start[head])
            gone = (doc != first_doc) | (start != first_start)
            if gone.any():
                yield out(*_settled(doc[gone], version[gone], start[gone], end[gone]))
            owner, context_at = (first_doc[-1], first_start[-1]), context[-1]
            # Anchors that begin and end in this batch, all at once.
            number = np.cumsum(new_gram)
            several = np.bincount(number, weights=new, minlength=number[-1] + 1) > 1
            frequent = np.bincount(number, weights=span & 1, minlength=number[-1] + 1) > 0
            pick = np.flatnonzero(~gone & (number > 0) & (number < number[-1]) & (several | frequent)[number])
            if len(pick):
                yield out(doc[pick], version[pick], start[pick], end[pick], gram[pick])
            # The anchor that the last batch ended in, and the one that this batch ends in.
            for n in sorted({0, int(number[-1])} & {int(number[0]), int(number[-1])}):
                here = np.flatnonzero(number == n)
                if at is None or gram[here[0]] != at:
                    if held:
                        yield from closer(held, contexts)
                    held, contexts, at = [], 0, gram[here[0]]
                contexts += int(new[here].sum())
                here = here[~gone[here]]
                held.append((doc[here], version[here], span[here]))
                if contexts > WIDE:
                    yield from closer(held, contexts)
                    held = []
        if held:
            yield from closer(held, contexts)

    return rows.mapInArrow(lean(work), FOUND_FIELDS)


WINDOWS = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])


def cut_contexts(docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the contexts (`places` of each document); of wide anchors every window by a hash of its bytes, without bytes.

    A wide window's key is its own hash; the second half of it is kept in its bytes, so that 128 bits decide.
    """
    import xxhash

    def work(batches):
        for batch in batches:
            rows = [[] for _ in range(5)]
            for doc, version, text, places in zip(*batch.columns, strict=True):
                data, doc, version = text.as_py().encode(), doc.as_py(), version.as_py()
                for place in places.as_py():
                    start, end, wide = place["start"], place["end"], place["wide"]
                    windows = [(start, data[start:end], place["gram"])] if not wide else [(s, digest[8:], int.from_bytes(digest[:8], "little", signed=True)) for s in range(start, end - length + 1) for digest in [xxhash.xxh3_128_digest(data[s : s + length])]]
                    for s, payload, gram in windows:
                        for column, value in zip(rows, (gram, doc, version, s, payload), strict=True):
                            column.append(value)
                if len(rows[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, WINDOWS, strict=True)], schema=WINDOWS)
                    rows = [[] for _ in range(5)]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, WINDOWS, strict=True)], schema=WINDOWS)

    return docs.mapInArrow(lean(work), "gram long, doc long, version long, start long, bytes binary")


def trimmed(contexts: list[bytes], length: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number, bytes, offset) of the contexts from their first window to their last whose hash the shard has twice."""
    keys, portion, size = [], [], 0
    for k, context in enumerate(contexts):
        portion.append(context)
        size += len(context)
        if size >= PIECE // 4 or k == len(contexts) - 1:
            sizes = np.array([len(c) for c in portion])
            inside = np.repeat(np.cumsum(sizes) - np.cumsum(sizes - length + 1), sizes - length + 1) - np.repeat(sizes - (sizes - length + 1), sizes - length + 1)
            at = np.arange(len(inside)) + inside
            keys.append(gram_hashes(np.frombuffer(b"".join(portion), np.uint8), length)[at])
            portion, size = [], 0
    key = np.concatenate(keys)
    windows = np.array([len(c) - length + 1 for c in contexts])
    owner = np.repeat(np.arange(len(contexts)), windows)
    offset = np.arange(len(key)) - np.repeat(np.cumsum(windows) - windows, windows)
    order = np.argsort(key)
    equal = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
    twice = np.sort(order[equal[1:] | equal[:-1]])
    if not len(twice):
        return twice, [], twice
    own, first = np.unique(owner[twice], return_index=True)
    low, high = offset[twice][first], offset[twice][np.append(first[1:], len(twice)) - 1]
    return own, [contexts[k][a : z + length] for k, a, z in zip(own.tolist(), low.tolist(), high.tolist(), strict=True)], low


def repeated_windows(contexts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the windows of a shard that are equal to one at a smaller doc or start, by its suffix array.

    Bytes that no repeated hash touches are left out first: they cannot be part of an equal window.
    """
    number, contexts, low = trimmed(contexts, length)
    if not len(number):
        return number, number
    doc, start = doc[number], start[number] + low
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = text.astype(np.int16) + 1
    symbols[base + sizes] = 0
    owner = np.repeat(np.arange(len(contexts), dtype=np.int32), sizes + 1)
    offset = (np.arange(len(text)) - base[owner]).astype(np.int32)
    order = suffix_array(symbols)
    order = order[offset[order] <= sizes[owner[order]] - length]
    group = np.cumsum(common_prefixes(text, order, length) < length)
    owner, offset = owner[order], offset[order]
    order = np.lexsort((start[owner] + offset, doc[owner], group))
    owner, offset, group = owner[order], offset[order], group[order]
    first = _first_of_equal((group,), doc[owner], start[owner] + offset)
    return number[owner[~first]], offset[~first] + low[owner[~first]]


def settle_shards(windows: DataFrame, length: int) -> DataFrame:
    """Removed bytes among contexts that share an anchor, and among single windows of wide ones."""

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc", "version", "start", "end"])

    def work(batches):
        held, size, last = [], 0, None
        key, owner = None, None  # the window of a wide anchor seen last, and its first place

        def shard(rows):
            contexts = [r[4] for r in rows]
            doc, version, start = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            context, offset = repeated_windows(contexts, doc, start, length)
            return out(_settled(doc[context], version[context], start[context] + offset, start[context] + offset + length))

        for batch in batches:
            single: list[tuple[int, int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gram, doc, version, start, payload = row
                if len(payload) < length:
                    if key != (gram, payload):
                        key, owner = (gram, payload), (doc, start)
                    elif owner != (doc, start):
                        single.append((doc, version, start))
                    continue
                if size >= SHARD and gram != last:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += len(payload)
                last = gram
            if single:
                doc, version, start = (np.array(x, np.int64) for x in zip(*single, strict=True))
                yield out(_settled(doc, version, start, start + length))
        if held:
            yield shard(held)

    return windows.mapInArrow(lean(work), "doc long, version long, start long, end long")


def document_of(docs: DataFrame, id_column: str) -> Column:
    """The id as a long, null last. Ids of another kind would all become null and count as one document, so they raise."""
    if docs.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_column} must be an integer column")
    return F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(document_of(docs, id_column).alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, version, spans) of the documents that lose bytes: each byte that a run of `length` bytes covers which also starts earlier.

    Earlier is a smaller id, or the same id and an earlier start. Runs do not cross documents and are judged on the input.
    Null texts are empty; null ids come last and count as one document, as do rows that share an id (equal rows keep the same
    bytes). spans: array of (start, end), maximal and in order. `length` is at least 2 * GRAM and below 2048.
    """
    if not 2 * GRAM <= length < 2048:
        raise ValueError("length must be between 48 and 2047 bytes")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs, id_column, text_column)
    long = texts.where(F.octet_length("text") >= length)
    rows = document_runs(long.select("doc", "version", "text"), length, frequent_grams(long, length))
    cell = F.when(F.col("span") == 0, F.xxhash64("doc", "gram")).when(F.col("span") % 2 == 1, F.xxhash64("gram", "context")).otherwise(F.col("gram"))
    dealt = rows.repartition(partitions, cell).sortWithinPartitions("gram", "context", "doc", "span")
    found = settle(compare_runs(dealt), "suffix-runs")
    unclear = found.where(F.col("gram").isNotNull())
    # Equal rows of a document are one from here on: their runs and their text count once. Most tables have none.
    repeated = not long.groupBy("doc", "version").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if repeated:
        unclear = unclear.distinct()
    # An anchor that was dealt by context may have one context only, and many are too many for one shard.
    several = unclear.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select("gram", (F.col("contexts") > WIDE).alias("wide"))
    places = unclear.join(several, "gram").groupBy("doc", "version").agg(F.collect_list(F.struct("start", "end", "gram", "wide")).alias("places"))
    once = long.select("doc", "version", "text")
    if repeated:
        once = once.dropDuplicates(["doc", "version"])
    contexts = cut_contexts(once.join(places, ["doc", "version"]).select("doc", "version", "text", "places"), length)
    sharded = contexts.repartition(partitions, F.col("gram")).sortWithinPartitions("gram", "bytes", "doc", "start")
    more = settle_shards(sharded, length)
    spans = found.where(F.col("gram").isNull()).select("doc", "version", "start", "end").unionByName(more)
    return settle(spans.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")), "suffix-spans")


def kept_parts(data: bytes, spans: list[dict] | None) -> tuple[list[bytes], int, int]:
    """What is left, and number of bytes and of maximal runs removed."""
    if not spans:
        return [data], 0, 0
    starts, ends = merged(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
    at, parts = 0, []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(data[at:s])
        at = e
    return [*parts, data[at:]], int((ends - starts).sum()), len(starts)


def with_spans(docs: DataFrame, spans: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows, and in a last column the spans that they lose; all other columns are kept whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), document_of(docs, id_column).alias("doc"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("version"))
    return rows.join(spans.select("doc", "version", "spans"), ["doc", "version"], "left").select("row.*", F.col("spans").alias(free_name(docs.columns, "spans")))


def removal_report(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def work(batches):
        for batch in batches:
            rows = [[] for _ in range(4)]
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                parts, removed, n = kept_parts(data, found.as_py())
                whole = hashlib.sha256()
                for part in parts:
                    whole.update(part)
                for column, value in zip(rows, (len(data), removed, n, whole.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.string())], names=[id_column, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return with_spans(docs.select(id_column, text_column), spans, id_column, text_column).mapInArrow(lean(work), f"`{id_column}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_spans(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with what is left of their text. A character of which only some bytes go stays whole.

    Null and empty texts lose nothing, and neither do texts without spans; a text that goes altogether is empty; equal rows
    lose the same.
    """

    def work(batches):
        place = -1
        for batch in batches:
            place = batch.schema.get_field_index(text_column)
            texts = []
            for text, found in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                text, spans = text.as_py(), found.as_py()
                if spans:
                    data = text.encode()
                    inside = lambda k: k < len(data) and data[k] & 0xC0 == 0x80  # noqa: B023, E731
                    whole = []
                    for s, e in zip(*(x.tolist() for x in merged(np.array([x["start"] for x in spans]), np.array([x["end"] for x in spans]))), strict=True):
                        while inside(s):
                            s += 1
                        while inside(e):
                            e -= 1
                        if s < e:
                            whole.append({"start": s, "end": e})
                    text = b"".join(kept_parts(data, whole)[0]).decode()
                texts.append(text)
            columns = list(batch.columns)[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return with_spans(docs, spans, id_column, text_column).mapInArrow(lean(work), docs.schema)
