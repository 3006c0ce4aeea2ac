"""Benchmark items in documents, by latent semantic retrieval and word-by-word checks.

Passages of all documents are TF-IDF rows over hashed words. A sparse random map of the passages sketches that matrix in
one distributed pass; the singular vectors of the sketch span the latent space. A second pass projects overlapping windows
of several lengths and the items into it and takes windows with a high cosine as candidates. What decides is how much of an
item the words around a candidate hold in the same order (longest common subsequence), and whether its answer is among them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltion.llm.shared import lean, settle


@dataclass
class Settings:
    features: int = 1 << 14  # hashed words
    passage: int = 64  # words of a passage in the sketch
    sketch: int = 192  # columns of the sketch
    rank: int = 96  # dimensions of the latent space
    skipped: int = 5  # leading dimensions left out: they only tell what all texts have in common
    block: int = 8  # words between the starts of two windows
    min_cosine: float = 0.4
    min_overlap: float = 0.5  # share of an item's words that must be around a candidate
    near_exact: float = 0.85  # share of an item found in order that is enough by itself
    paraphrase: float = 0.6  # share that is enough if the answer is found too
    answer_share: float = 0.75
    answer_words: int = 8  # an item without an answer has its last words for one
    common: float = 0.1  # words in a larger share of the distinct passages are left out of the comparison; an item with few others is compared whole, in a run of about its length
    least_words: int = 4  # other words that an item needs for that
    items_at_once: int = 20_000  # items are searched in blocks of about so many: the bound of what is sent to the tasks


# Letters, digits and all bytes of other scripts are parts of words.
WORD_BYTE = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
FACTOR = 0x9E3779B97F4A7C15
VALUES = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(FACTOR)
    return hashes ^ hashes >> np.uint64(29)


class Words:
    """Hashes of the words of many texts at once."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if n >= len(self.up):
            n = max(n + 1, 1 << 20)
            back = pow(FACTOR, -1, 1 << 64)
            for name, factor in (("up", FACTOR), ("down", back)):
                steps = np.full(n, np.uint64(factor))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of all words in order, and the number of words of each text."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        folded = FOLD[data]
        # Upper-case Latin letters of two bytes.
        folded[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)).astype(np.uint8) << 5
        inside = WORD_BYTE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        self.powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[folded] * self.up[: len(data)])])
        hashes = mixed((sums[ends] - sums[starts]) * self.down[starts])
        cuts = np.cumsum([len(t) + 1 for t in texts])
        return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, cuts)]))


def portions(texts, most: int = 1_000_000):
    """(first, texts in UTF-8) of runs of rows of about `most` bytes."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        data = (text.as_py() or "").encode()
        held.append(data)
        size += len(data)
        if size >= most:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def sketch(docs: DataFrame, settings: Settings, text_column: str = "text") -> tuple[np.ndarray, np.ndarray, int]:
    """(passages with each feature, sketch of features by columns, number of passages) over the distinct passages of all documents.

    Passages with the same features count once, so copies of a text do not make its words common. Every passage is added to
    one column of the sketch, with a sign; both are drawn by a hash of its features. A task adds up what it reads; the sums
    are added in slices, and the driver gets one matrix whose size the settings bound.
    """
    d, width, slices = settings.features, settings.sketch + 1, 32
    kind = np.dtype(np.uint16 if d < 1 << 16 else np.uint32)

    def passages_of(batches):
        words = Words()
        for batch in batches:
            for _, texts in portions(batch.column(0)):
                hashes, counts = words.split(texts)
                if not len(hashes):
                    continue
                # Rows of passages, padded; a document's last one may be short.
                rows = -(-counts // settings.passage)
                starts = np.cumsum(rows) - rows
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts) * settings.passage
                matrix = np.full(int(rows.sum()) * settings.passage, d, kind)
                matrix[place] = hashes >> np.uint64(64 - (d.bit_length() - 1))
                matrix = np.sort(matrix.reshape(-1, settings.passage), axis=1)
                matrix[:, 1:][matrix[:, 1:] == matrix[:, :-1]] = d
                data = pa.py_buffer(np.sort(matrix, axis=1).tobytes())
                found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(settings.passage * kind.itemsize), len(matrix), [None, data])
                yield pa.RecordBatch.from_arrays([found.cast(pa.binary())], names=["passage"])

    def work(batches):
        total, passages = np.zeros((d, width), np.float64), 0
        for batch in batches:
            matrix = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(-1, settings.passage).astype(np.int64)
            if not len(matrix):
                continue
            first = matrix < d
            drawn = mixed(np.where(first, VALUES[matrix & 255] * (matrix + 1).astype(np.uint64), 0).sum(1, dtype=np.uint64))
            column = (drawn >> np.uint64(33)).astype(np.int64) % settings.sketch
            sign = np.where(drawn & np.uint64(1), 1.0, -1.0)
            where = matrix * width + column[:, None]
            total += np.bincount(where[first], np.broadcast_to(sign[:, None], first.shape)[first], (d + 1) * width)[: d * width].reshape(d, width)
            total[:, -1] += np.bincount(matrix[first], minlength=d)[:d]
            passages += len(matrix)
        for k, part in enumerate(np.split(total, slices)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary()), pa.array([passages if k == 0 else 0], pa.int64())], names=["slice", "part", "passages"])

    def add(batches):
        sums, passages = {}, {}
        for batch in batches:
            for k, part, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part, np.float32).astype(np.float64)
                passages[k] = passages.get(k, 0) + n
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([passages[k]], pa.int64())], names=["slice", "part", "passages"])

    fields = "slice int, part binary, passages long"
    # Few tasks: each gives a whole matrix.
    distinct = docs.select(text_column).mapInArrow(passages_of, "passage binary").distinct().coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    found = sorted(distinct.mapInArrow(lean(work), fields).repartition(slices, "slice").mapInArrow(add, fields).collect())
    if not found:
        return np.zeros(d), np.zeros((d, settings.sketch)), 0
    whole = np.concatenate([np.frombuffer(r.part).reshape(-1, width) for r in found])
    return whole[:, -1], whole[:, :-1], sum(r.passages for r in found)


@dataclass
class Space:
    vectors: np.ndarray  # of the latent space for every feature, its weight included; a row of zeros at the end
    common: np.ndarray  # features that say little


def latent_space(document_frequency: np.ndarray, sketched: np.ndarray, passages: int, settings: Settings) -> Space:
    idf = np.log((passages + 1) / (document_frequency + 1))
    left, values, _ = np.linalg.svd(idf[:, None] * sketched, full_matrices=False)
    kept = slice(settings.skipped, settings.skipped + settings.rank)
    vectors = (idf[:, None] * left[:, kept]).astype(np.float32)
    return Space(np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)]), document_frequency > settings.common * passages)


@dataclass
class Items:
    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)  # those that are compared
    whole: list[bool] = field(default_factory=list)  # common words are compared too
    answers: list[dict[int, int]] = field(default_factory=list)
    answer_words: list[int] = field(default_factory=list)
    reach: list[int] = field(default_factory=list)  # words around a candidate that are compared
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # window: item numbers, unit vectors
    masks: list[dict[int, int]] = field(default_factory=list)  # word: its places in the item as bits


def scale_of(words: int, settings: Settings) -> int:
    scale = 2 * settings.block
    while scale < words:
        scale *= 2
    return scale


def window_of(words: int, settings: Settings) -> int:
    """The shortest window that holds so many words; windows are whole blocks, at most a quarter or one block apart."""
    window = 2 * settings.block
    while window < words:
        window = settings.block * max(window // settings.block + 1, int(1.25 * window) // settings.block)
    return window


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def feature_of(hashes: np.ndarray, settings: Settings) -> np.ndarray:
    return (hashes >> np.uint64(64 - (settings.features.bit_length() - 1))).astype(np.int64)


def places_of(words: np.ndarray) -> dict[int, int]:
    """Places of each word as bits."""
    places: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        places[w] = places.get(w, 0) | 1 << k
    return places


def prepare(rows: list, space: Space, settings: Settings) -> Items:
    """Items with at least one word, with their latent vectors by the window length they are searched with."""
    items, split, windows, vectors = Items(), Words(), [], []
    for item_id, text, answer in rows:
        words = split.split([(text or "").encode()])[0]
        if not len(words):
            continue
        telling = words[~space.common[feature_of(words, settings)]]
        whole = len(telling) < settings.least_words
        own = split.split([(answer or "").encode()])[0]
        own = own if len(own) else (words if whole else telling)[-settings.answer_words :]
        if not whole:
            own = own[~space.common[feature_of(own, settings)]] if (~space.common[feature_of(own, settings)]).any() else own
        items.ids.append(item_id)
        items.words.append(words if whole else telling)
        items.whole.append(whole)
        items.masks.append(places_of(items.words[-1]))
        items.answers.append(places_of(own))
        items.answer_words.append(len(own))
        items.reach.append(scale_of(len(words), settings))
        windows.append(window_of(len(words), settings))
        vectors.append(space.vectors[feature_of(words, settings)].sum(0))
    for window in sorted(set(windows)):
        chosen = np.flatnonzero(np.array(windows) == window)
        items.by_length[window] = (chosen, unit(np.stack([vectors[i] for i in chosen])))
    return items


def in_order(places: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (words' places as bits) and a run of words."""
    state, full = (1 << size) - 1, (1 << size) - 1
    for w in words:
        here = places.get(w)
        if here:
            step = state & here
            state = (state + step | state - step) & full
    return size - state.bit_count()


def candidates(hashes: np.ndarray, counts: np.ndarray, space: Space, items: Items, settings: Settings):
    """Arrays (document, first word, window length, item, cosine) of windows that are near an item."""
    block = settings.block
    blocks = -(-counts // block)
    first_block = np.cumsum(blocks) - blocks
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first_block, counts) * block
    features = np.full(int(blocks.sum()) * block, settings.features, np.int64)
    features[place] = feature_of(hashes, settings)
    features = features.reshape(-1, block)
    sums = np.zeros((len(features) + 1, space.vectors.shape[1]), np.float32)
    for k in range(block):
        sums[1:] += space.vectors[features[:, k]]
    totals = np.cumsum(sums, axis=0, dtype=np.float64)
    owner = np.repeat(np.arange(len(counts)), blocks)
    end_of = np.repeat(first_block + blocks, blocks)
    at = np.arange(len(features))
    for window, (numbers, vectors) in items.by_length.items():
        # A window that would start inside the last one of its document, and end with it, adds nothing.
        starts = at[(at == first_block[owner]) | (at + window // block <= end_of)]
        ends = np.minimum(starts + window // block, end_of[starts])
        for k in range(0, len(starts), 8192):
            s, e = starts[k : k + 8192], ends[k : k + 8192]
            near = unit(totals[e] - totals[s]).astype(np.float32) @ vectors.T
            i, j = np.nonzero(near >= settings.min_cosine)
            if len(i):
                yield owner[s[i]], (s[i] - first_block[owner[s[i]]]) * block, np.full(len(i), window), numbers[j], near[i, j]


MATCHES = "item int, cosine double, item_words int, in_order int, first_word int, last_word int, answer_found double, kind string"


def checked(words: np.ndarray, first: int, scale: int, item: int, space: Space, items: Items, settings: Settings) -> tuple[int, float, str] | None:
    """(words in order, share of the answer, kind) of an item around a window, or None if it is not there."""
    size, places = len(items.words[item]), items.masks[item]
    around = words[max(0, first - scale // 2) : first + scale + scale // 2]
    here = set(around.tolist())
    if sum(p.bit_count() for w, p in places.items() if w in here) < settings.min_overlap * size:
        return None
    if items.whole[item]:  # common words are in order anywhere: words far from the window do not count, unless the item is there as it is
        if items.words[item].tobytes() in around.tobytes():
            return size, 1.0, "near exact"
        around = words[max(0, first - settings.block) : first + window_of(size, settings)].tolist()
    else:
        around = around[~space.common[feature_of(around, settings)]].tolist()
    found = in_order(places, size, around)
    if found < settings.paraphrase * size:
        return None
    share = in_order(items.answers[item], items.answer_words[item], around) / items.answer_words[item]
    if found >= settings.near_exact * size:
        return found, share, "near exact"
    return (found, share, "paraphrase") if share >= settings.answer_share else None


def search(docs: DataFrame, space: Space, items: Items, settings: Settings, id_column: str, text_column: str) -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches):
        split = Words()
        for batch in batches:
            rows = []
            for base, texts in portions(batch.column(1)):
                hashes, counts = split.split(texts)
                if not len(hashes):
                    continue
                begins = np.cumsum(counts) - counts
                best: dict[tuple[int, int], list] = {}
                for found in candidates(hashes, counts, space, items, settings):
                    for doc, first, window, item, cosine in zip(*(x.tolist() for x in found), strict=True):
                        words = hashes[begins[doc] : begins[doc] + counts[doc]]
                        hit = checked(words, first, items.reach[item], item, space, items, settings)
                        if hit and (hit[0], cosine) > tuple(best.get((doc, item), (0, 0.0))[:2]):
                            best[doc, item] = [hit[0], cosine, first, min(first + window, int(counts[doc])), hit[1], hit[2]]
                rows += [(base + doc, item, *values) for (doc, item), values in best.items()]
            if rows:
                at, item, found, cosine, first, last, share, verdict = (list(c) for c in zip(*rows, strict=True))
                columns = [pa.array(item, pa.int32()), pa.array(cosine, pa.float64()), pa.array([len(items.words[i]) for i in item], pa.int32()), pa.array(found, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(share, pa.float64()), pa.array(verdict, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=["id", "item", "cosine", "item_words", "in_order", "first_word", "last_word", "answer_found", "kind"])

    return docs.select(id_column, text_column).mapInArrow(lean(work), f"id {kind}, {MATCHES}")


def find_items(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, cosine, item_words (compared), in_order (of
    them, found in order), first_word and last_word of the window, answer_found (share of the answer) and kind (near exact or
    paraphrase).

    `benchmark` has item_id and text, and `answer` if there is one. Items without a word are not searched; equal items each
    have their rows; null and empty texts hold nothing; repeated documents have their rows each; null ids are kept. Whole
    texts, all documents, all items. Without documents or items the result is empty.
    """
    settings = settings or Settings()
    space = latent_space(*sketch(docs, settings, text_column), settings)
    rows = benchmark.select("item_id", "text", (F.col("answer") if "answer" in benchmark.columns else F.lit(None)).cast("string").alias("answer"))
    parts = max(1, -(-rows.count() // settings.items_at_once))
    out = None
    for part in range(parts):
        held = sorted(rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect(), key=str)
        items = prepare(held, space, settings)
        item_ids = items.ids
        found = search(docs, space, items, settings, id_column, text_column)
        names = docs.sparkSession.createDataFrame(list(enumerate(item_ids)), f"item int, item_id {benchmark.schema['item_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(names), "item").select(F.col("id").alias(id_column), "item_id", "cosine", "item_words", "in_order", "first_word", "last_word", "answer_found", "kind")
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Rows with a null id are told apart by their text.

    Null and empty texts hold nothing and stay; equal rows go or stay together.
    """
    key = F.struct(F.col(id_column).alias("i"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("t"))
    texts = docs.select(key.alias("_key"), F.col(text_column).alias("_text"))
    held = settle(find_items(texts, benchmark, settings, "_key", "_text").select("_key").distinct(), "contaminated")
    held = held.select(F.col("_key.i").alias("_i"), F.col("_key.t").alias("_t"))
    marked = docs.select(F.struct("*").alias("row"), key.alias("_key"))
    return marked.join(held, F.col("_key.i").eqNullSafe(F.col("_i")) & (F.col("_key.t") == F.col("_t")), "left_anti").select("row.*")
