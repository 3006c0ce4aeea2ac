"""Near-duplicates by SimHash and a Gray-order hierarchical index.

Fingerprints that differ in at most d bits agree in at least one of d + 1 blocks of bits, so each goes once into the cell
of each of its blocks; a cell that many share is cut again by the bits not used yet, until it is small. In a cell the
fingerprints are sorted by Gray rank, where neighbours differ in few bits, and stacked into a tree: a node holds the bits
that all fingerprints below it share and its ancestors do not hold. A search adds up the differences from the top and
drops a whole subtree once they exceed d. A cell gives a spanning star of each of its groups, not its pairs; stars of
different cells are joined by alternating large-star and small-star steps.

`one_of_each` removes rows, so it takes links only as candidates: they are pairs of rows there, each compared by the Jaccard
similarity of its distinct shingles before groups are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltion.llm.shared import forget, lean, marked, settle

SEED = 42
FAN = 16
CELL = 4096
BANDS, BAND = 20, 6  # smallest hashes of a shingle set: so many bands of so many


def fingerprint(data: bytes, shingle: int, chunk: int = 65_536) -> int:
    """64-bit SimHash of a text in UTF-8; 0 without words. `data` is lower-cased in A-Z only and cut at ASCII blanks."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, chunk):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[k : k + chunk], last[k : k + chunk], strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) of every row, fp as a signed 64-bit integer; null and empty texts have 0. Whole texts; a narrow step."""

    def work(batches):
        for batch in batches:
            found = np.array([fingerprint((t.as_py() or "").encode(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=[id_column, "fp"])

    return docs.select(id_column, text_column).mapInArrow(lean(work), f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, fp long")


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, cut into words as `fingerprint` does; fewer words are one shingle."""
    import xxhash

    words, digest = data.lower().split(), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + shingle]), SEED) for k in range(n)), np.uint64, n))


def set_fingerprint(hashes: np.ndarray, chunk: int = 65_536) -> int:
    """64-bit SimHash of distinct shingles as a signed integer; 0 without any."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), chunk):
        ones += np.unpackbits(hashes[k : k + chunk].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return signed(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big"))


def bands(hashes: np.ndarray, chunk: int = 2048) -> list[int]:
    """One signed 64-bit value for each band of smallest hashes under fixed orders: sets of similarity s share one with 1 - (1 - s^BAND)^BANDS."""
    if not len(hashes):
        return []
    flips, factors, weights = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * BAND), np.uint64) | np.uint64(1)
    least = np.full(BANDS * BAND, ~np.uint64(0))
    for k in range(0, len(hashes), chunk):
        ordered = hashes[k : k + chunk] ^ flips[:, None]
        ordered *= factors[:, None]
        np.minimum(least, ordered.min(1), out=least)
    return (least * weights).reshape(BANDS, BAND).sum(1, dtype=np.uint64).view(np.int64).tolist()


def shingle_sets(docs: DataFrame, shingle: int, id_column: str, text_column: str, batch_rows: int = 1000) -> DataFrame:
    """(id, digest, fp, bands, members) of every row. Rows with equal shingles have the same digest; members are their hashes in 32 bits."""
    import xxhash

    def work(batches):
        for batch in (whole.slice(at, batch_rows) for whole in batches for at in range(0, whole.num_rows, batch_rows)):
            digests, fps, banded, members = [], [], [], []
            for text in batch.column(1):
                hashes = shingle_set((text.as_py() or "").encode(), shingle)
                digests.append(signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)))
                fps.append(set_fingerprint(hashes))
                banded.append(bands(hashes))
                members.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes())
            columns = [pa.array(digests, pa.int64()), pa.array(fps, pa.int64()), pa.array(banded, pa.list_(pa.int64())), pa.array(members, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_column, "digest", "fp", "bands", "members"])

    return docs.select(id_column, text_column).mapInArrow(lean(work), f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, digest long, fp long, bands array<long>, members binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose sets have at least this Jaccard similarity; `sets` has (digest, members) once for each."""

    def work(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(m.as_py(), np.uint32) for m in (x, y))
                both = 0
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    merged = np.sort(np.concatenate([x, y]), kind="stable")
                    both = int((merged[1:] == merged[:-1]).sum())
                near.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, other = (sets.select(F.col("digest").alias(c), F.col("members").alias(f"members_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "members_a", "members_b").mapInArrow(lean(work), "a long, b long")


def blocks_of(free: list[int], parts: int) -> list[int]:
    """Masks of `parts` blocks of about equal size over the free bit positions."""
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cut(cells: DataFrame, distance: int) -> DataFrame:
    """Every (mask, value, fp) once for each block of the bits outside its mask, which joins the mask."""

    def work(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            masks, fps = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("mask", "fp"))
            out_mask, out_fp = [], []
            for mask in np.unique(masks):
                known = blocks.get(int(mask))
                if known is None:
                    known = blocks[int(mask)] = np.array([int(mask) | b for b in blocks_of([i for i in range(64) if not int(mask) >> i & 1], distance + 1)], np.uint64)
                here = fps[masks == mask]
                out_mask.append(np.tile(known, len(here)))
                out_fp.append(np.repeat(here, len(known)))
            new_mask, new_fp = np.concatenate(out_mask), np.concatenate(out_fp)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (new_mask, new_mask & new_fp, new_fp)], names=["mask", "value", "fp"])

    return cells.select("mask", "value", "fp").mapInArrow(lean(work), "mask long, value long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order: the running exclusive or of its bits."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The tree over fingerprints sorted by Gray rank; level 0 are the fingerprints themselves."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        masks, patterns = [np.full(len(fps), ~np.uint64(0))], [self.fps]
        while len(masks[-1]) > 1:
            starts = np.arange(0, len(masks[-1]), FAN)
            first = np.repeat(patterns[-1][starts], np.diff(np.append(starts, len(masks[-1]))))
            shared = np.bitwise_and.reduceat(masks[-1], starts) & ~np.bitwise_or.reduceat(patterns[-1] ^ first, starts)
            masks.append(shared)
            patterns.append(patterns[-1][starts] & shared)
        self.masks, self.patterns = masks, patterns
        # What an ancestor holds is taken out of the nodes below.
        self.own = [m & ~np.repeat(up, FAN)[: len(m)] for m, up in zip(masks, masks[1:], strict=False)] + [masks[-1]]

    def links(self, distance: int, chunk: int = 512):
        """Arrays (i, j), i < j in Gray order, of fingerprints that differ in at most `distance` bits."""
        top = len(self.masks) - 1
        for k in range(0, len(self.fps), chunk):
            query = np.arange(k, min(k + chunk, len(self.fps)))
            node, far = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
            for level in range(top, -1, -1):
                if level < top:
                    children = node[:, None] * FAN + np.arange(FAN)
                    query, far = np.repeat(query, FAN), np.repeat(far, FAN)
                    node = children.ravel()
                    # The last fingerprint below the node must come after the query: every pair is met once.
                    inside = (node < len(self.masks[level])) & ((node + 1) * FAN**level - 1 > query)
                    query, node, far = query[inside], node[inside], far[inside]
                far = far + np.bitwise_count((self.fps[query] ^ self.patterns[level][node]) & self.own[level][node])
                near = far <= distance
                query, node, far = query[near], node[near], far[near]
            later = node > query
            if later.any():
                yield query[later], node[later]


def stars(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest of its group) for the groups that links within the cell make, without the smallest ones."""
    index = GrayIndex(fps)
    own = index.fps.view(np.int64)
    label = np.argsort(np.argsort(own))  # the place among the signed values, so the smallest label is the smallest value
    value = np.sort(own)
    for i, j in index.links(distance):
        while True:
            # Roots of both ends take the smaller one; then all follow their roots.
            a, b = label[i], label[j]
            if (a == b).all():
                break
            root = np.arange(len(own))
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            label = root[label]
    return own[value[label] != own], value[label][value[label] != own]


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smaller) of the cell that hold its groups together: a spanning forest of pairs within `distance`."""
    index = GrayIndex(fps)
    own, label, found = index.fps.view(np.int64), np.arange(len(fps)), []
    for i, j in index.links(distance):
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            # Each root is hung below a smaller one by one link, which stays.
            chosen = np.unique(high, return_index=True)[1]
            found.append((i[chosen], j[chosen]))
            root = np.arange(len(own))
            root[high[chosen]] = low[chosen]
            while (root[root] != root).any():
                root = root[root]
            label = root[label]
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return np.maximum(own[i], own[j]), np.minimum(own[i], own[j])


def cell_links(cells: DataFrame, distance: int, partitions: int, edges_of=stars) -> DataFrame:
    """Edges (a, b), a > b, of all cells as `edges_of` gives them. Cells are small here, and a task streams through its own."""

    def work(batches):
        held: list[np.ndarray] = []
        at = None

        def emit(parts: list[np.ndarray]):
            fps = np.unique(np.concatenate(parts))
            if len(fps) > 1:
                yield edges_of(fps, distance)

        def pack(found):
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            found = []
            mask, value, fps = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if not len(fps):
                continue
            edges = np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1
            starts = np.concatenate([[0], edges, [len(fps)]])
            for s, e in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                key = (mask[s], value[s])
                if key != at:
                    if len(held) > 1 or held and len(held[0]) > 1:
                        found += emit(held)
                    held, at = [], key
                held.append(fps[s:e].view(np.uint64))
            if found:
                yield pack(found)
        if held and (found := list(emit(held))):
            yield pack(found)

    dealt = cells.repartition(partitions, "mask", "value").sortWithinPartitions("mask", "value")
    return dealt.select("mask", "value", "fp").mapInArrow(lean(work), "a long, b long")


def links(fps: DataFrame, distance: int, edges_of=stars) -> DataFrame:
    """Edges (a, b), a > b, that connect the distinct fingerprints (fp) as links of at most `distance` bits do.

    Cells of more than CELL fingerprints are cut again, by one level for all of them at a time. A cell has each fingerprint
    once, so one that is too large has more than `distance` bits left to be cut by, and in the end all are small enough.
    """
    if 1 << distance > CELL:
        raise ValueError("too large a distance for cells of this size")
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if distance <= 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    cells, out = settle(cut(fps.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"), "fp"), distance), "simhash-cells"), []
    while True:
        large = settle(cells.groupBy("mask", "value").count().where(F.col("count") > CELL).select("mask", "value"), "simhash-large")
        last = large.isEmpty()
        out.append(cell_links(cells if last else cells.join(large, ["mask", "value"], "left_anti"), distance, partitions, edges_of))
        if last:
            break
        cells = settle(cut(cells.join(large, ["mask", "value"], "left_semi"), distance).distinct(), "simhash-cells")
    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a smaller one in its component: the root is the smallest.

    Large-star links all larger neighbours of a node to its smallest neighbour, small-star all smaller ones. Smallest
    neighbours are partial aggregates, so a node with very many neighbours is one row per task.
    """
    edges = settle(edges.select("a", "b").where("a > b").distinct(), "components")
    seen = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)))).first())
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        edges = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a")
        edges = settle(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct(), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    fingerprint: 16 hex digits of the SimHash over `shingle`-word shingles, repeats included (fewer words: all of them as
    one shingle; none: zero). Rows are linked if their fingerprints differ in at most `distance` bits; component_id is the
    smallest id that links reach, itself included. Null and empty texts have fingerprint zero and are linked like any
    other; repeated rows stay; rows with a null id take part, and have a null component only where nobody has an id.

    Equal fingerprints are one node throughout, so a group of copies of any size is one row of the index.
    """
    rows = settle(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min(id_column).alias("first_id")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), distance))
    placed = settle(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = placed.join(named, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def fingerprint_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of digests to compare: those of one fingerprint with its smallest, and the smallest of fingerprints that are linked."""
    by_fp = settle(nodes.groupBy("fp").agg(F.min("digest").alias("least")), "simhash-nodes")
    same = nodes.join(by_fp, "fp").select(F.col("digest").alias("a"), F.col("least").alias("b"))
    ends = [by_fp.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in ("a", "b")]
    linked = links(by_fp.select("fp"), distance, forest).join(ends[0], "a").join(ends[1], "b")
    return same.unionByName(linked.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def band_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of digests to compare: those that share a band with its smallest and with its largest."""
    banded = nodes.select("digest", F.explode("bands").alias("band"))
    ends = banded.groupBy("band").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low < high")
    return banded.join(ends, "band").select(F.col("digest").alias("a"), F.explode(F.array("low", "high")).alias("b"))


def sketch(members: np.ndarray) -> bytes:
    """A map of bits of the lower halves of the hashes, two to four bits (a power of two, 64 at least) for each member."""
    bits = np.zeros(1 << max(6, (2 * len(members) - 1).bit_length()), np.uint8)
    bits[members & np.uint32(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(x: bytes, size_x: int, y: bytes, size_y: int) -> int:
    """No two sets with these sketches share more members than this: a bit that only one of them has is a member that the other lacks."""
    least = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, least), axis=0).view(np.uint64) for m in (x, y))
    return min(size_x - int(np.bitwise_count(x & ~y).sum()), size_y - int(np.bitwise_count(y & ~x).sum()))


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and sketches of their sets do not rule out; `sketches` has (digest, size, bits) once for each."""

    def work(batches):
        for batch in batches:
            x, y, left = *(batch.column(c).to_pylist() for c in ("bits_a", "bits_b")), []
            for p, m, q, n in zip(x, batch.column("size_a").to_pylist(), y, batch.column("size_b").to_pylist(), strict=True):
                left.append(min(m, n) >= similarity * max(m, n) - 1e-6 and (both := most_shared(p, m, q, n)) >= similarity * (m + n - both) - 1e-6)
            yield batch.select(["a", "b"]).filter(pa.array(left, pa.bool_()))

    one, other = (sketches.select(F.col("digest").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(other, "b").mapInArrow(lean(work), "a long, b long")


def sets_of(pairs: DataFrame, rows: DataFrame, columns: dict[str, str], make) -> DataFrame:
    """(digest, columns) once for each digest of the pairs, as `make` gives the columns of the members.

    Members are as much as the texts, so sets that a map of the digests rules out are not dealt.
    """
    compared = pairs.select(F.col("a").alias("digest")).union(pairs.select("b"))
    known = marked(compared)

    def work(batches):
        for batch in batches:
            batch = batch.filter(pa.array(known(batch.column(0).to_numpy())))
            made = make([np.frombuffer(m.as_py(), np.uint32) for m in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["digest", *columns])

    found = rows.select("digest", "members").mapInArrow(lean(work), ", ".join(["digest long", *(f"{c} {kind}" for c, kind in columns.items())]))
    return found.join(compared.distinct(), "digest", "left_semi").groupBy("digest").agg(*(F.first(c).alias(c) for c in columns))


def compare(pairs: DataFrame, rows: DataFrame, similarity: float, label: str) -> DataFrame:
    """The pairs (a, b) of digests, a > b, whose sets have at least this similarity, as a written table; each is compared once.

    Sketches are a tenth of the sets; they go first and rule out most pairs that are not similar, and only those.
    """
    pairs = settle(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-pairs")
    sketches = settle(sets_of(pairs, rows, {"size": "int", "bits": "binary"}, lambda sets: [pa.array([len(x) for x in sets], pa.int32()), pa.array([sketch(x) for x in sets], pa.binary())]), f"{label}-sketches")
    left = settle(possible(pairs, sketches, similarity), f"{label}-possible")
    forget(pairs, sketches)
    sets = settle(sets_of(left, rows, {"members": "binary"}, lambda sets: [pa.array([x.tobytes() for x in sets], pa.binary())]), f"{label}-sets")
    near = settle(similar(left, sets, similarity), f"{label}-links")
    forget(left, sets)
    return near


def frequent(rows: DataFrame, least: int = 4, limit: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many sets hold them) of the shingles that many sets share, sorted by hash.

    Counted in one set in 16, or in some 4 000 where there are fewer. They only decide in which order the shingles of a set are
    taken and how a cell is dealt; the pairs found do not depend on them.
    """

    def work(batches):
        for batch in batches:
            held = [np.frombuffer(m.as_py(), np.uint32).view(np.int32) for m in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*held, np.zeros(0, np.int32)]))], names=["token"])

    step = min(16, max(1, rows.count() // 4000))
    counts = rows.where(F.pmod(F.xxhash64("digest"), F.lit(step)) == 0).select("members").mapInArrow(lean(work), "token int").groupBy("token").count()
    found = np.array([(r[0], r[1]) for r in counts.where(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(limit).collect()], np.int64).reshape(-1, 2)
    hashes = found[:, 0].astype(np.int32).view(np.uint32)
    order = np.argsort(hashes)
    return hashes[order], found[order, 1] * step


def prefix(members: np.ndarray, known: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The leading shingles of a set in the order from rare to frequent, then by hash: one more than it may lack of those that a
    set of this similarity shares with it, so the leading shingles of both have one in common."""
    n = len(members)
    size = n - int(np.ceil(similarity * n - 1e-6)) + 1 if n else 0
    at = np.searchsorted(known, members)
    often = np.zeros(n, bool)
    inside = at < len(known)
    often[inside] = known[at[inside]] == members[inside]
    rare = members[~often]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate([rare, members[often][np.argsort(counts[at[often]], kind="stable")]])[:size]


def prefixes(rows: DataFrame, known: np.ndarray, counts: np.ndarray, similarity: float) -> DataFrame:
    """(digest, size, prefix) of the distinct sets."""

    def work(batches):
        for batch in batches:
            sets = [np.frombuffer(m.as_py(), np.uint32) for m in batch.column(1)]
            leading = [prefix(x, known, counts, similarity).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(leading, pa.binary())], names=["digest", "size", "prefix"])

    found = rows.select("digest", "members").mapInArrow(lean(work), "digest long, size int, prefix binary")
    return found.groupBy("digest").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))


def class_of(digest: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return ((digest.view(np.uint64) >> np.uint64(20)) % classes.astype(np.uint64)).astype(np.int64)


def cells_of(placed: DataFrame, known: np.ndarray, counts: np.ndarray, block: int = 2048) -> DataFrame:
    """(cell, digest, root, place) for each leading shingle; `place` has the size of the set and, in the lower half, where it stands.

    The sets that share a frequent shingle are dealt to classes (1 000 at most), and each pair of classes has a cell of its
    own. A cell has the shingle in its lower half and, above it, the two classes and how many there are.
    """

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                digest, root, size = (part.column(c).to_numpy(zero_copy_only=False) for c in ("digest", "root", "size"))
                tokens = [np.frombuffer(p.as_py(), np.uint32) for p in part.column(3)]
                lengths = np.array([len(t) for t in tokens], np.int64)
                token = np.concatenate([*tokens, np.zeros(0, np.uint32)])
                row, at = np.repeat(np.arange(len(tokens)), lengths), np.concatenate([*map(np.arange, lengths), np.zeros(0, np.int64)])
                where = np.searchsorted(known, token)
                often = where < len(known)
                often[often] = known[where[often]] == token[often]
                classes = np.ones(len(token), np.int64)
                classes[often] = np.minimum(1 + counts[where[often]] // block, 1000)
                own = class_of(digest[row], classes)
                first = np.repeat(np.arange(len(token)), classes)
                other = np.arange(len(first)) - np.repeat(np.cumsum(classes) - classes, classes)
                own, low, high = own[first], np.minimum(own[first], other), np.maximum(own[first], other)
                cell = token[first].astype(np.int64) | low << 52 | high << 42 | (classes[first] - 1) << 32
                row, at = row[first], at[first]
                place = size[row].astype(np.int64) << 32 | at
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, digest[row], root[row], place)], names=["cell", "digest", "root", "place"])

    return placed.select("digest", "root", "size", "prefix").mapInArrow(lean(work), "cell long, digest long, root long, place long")


def pairs_of(columns: list[np.ndarray], similarity: float, emit: int = 100_000):
    """Arrays (a, b) of the digests of a run of whole cells, sorted by cell, that are in different groups and can be similar.

    Where the first shingle that two sets share stands at i and j, they share no more than what follows in either.
    """
    cell, digest, root, place = columns
    size, at = place >> 32, place & 0xFFFFFFFF
    mixed = cell >> 52 != cell >> 42 & 1023
    side = class_of(digest, (cell >> 32 & 1023) + 1)
    left, need, held, n = np.arange(len(cell)), similarity / (1 + similarity), [], 0
    for step in range(1, len(cell)):
        left = left[left + step < len(cell)]
        left = left[cell[left] == cell[left + step]]
        if not len(left):
            break
        i, j = left, left + step
        i, j = (x[(root[i] != root[j]) & (~mixed[i] | (side[i] != side[j]))] for x in (i, j))
        near = np.minimum(size[i] - at[i], size[j] - at[j]) >= np.maximum(need * (size[i] + size[j]), 1) - 1e-6
        near &= np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
        i, j = digest[i[near]], digest[j[near]]
        if len(i):
            held.append(np.stack([np.maximum(i, j), np.minimum(i, j)], 1))
            n += len(i)
        if n > emit:
            yield np.unique(np.concatenate(held), axis=0).T
            held, n = [], 0
    if held:
        yield np.unique(np.concatenate(held), axis=0).T


def cell_pairs(cells: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), a > b, of all cells. A task streams through its cells and holds one batch and the cell at its end."""

    def work(batches):
        held = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            for a, b in pairs_of([c[:last] for c in columns], similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held = [c[last:].copy() for c in columns]
        if held is not None:
            for a, b in pairs_of(held, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    partitions = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(partitions, "cell").sortWithinPartitions("cell").mapInArrow(lean(work), "a long, b long")


def linked_exactly(rows: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(node, root) after every pair of sets that can reach the similarity was compared or is in one group already.

    Sets of at least this similarity share one of their leading shingles (`prefix`), so no pair is left out. A large family of
    near copies whose members are not similar to each other still gives a comparison for each two of them that sizes and places
    of shingles allow: that part grows with the square of the family.
    """
    roots = settle(components(found), "simhash-roots")
    known, counts = frequent(rows)
    leading = prefixes(rows, known, counts, similarity).where("size > 0")
    placed = leading.join(roots, leading["digest"] == roots["node"], "left").select("digest", F.coalesce("root", "digest").alias("root"), "size", "prefix")
    more = compare(cell_pairs(cells_of(placed, known, counts), similarity), rows, similarity, "simhash-exact")
    return roots if more.isEmpty() else components(found.unionByName(more))


def one_of_each(docs: DataFrame, shingle: int = 5, distance: int = 7, id_column: str = "doc_id", text_column: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows with the smallest id of their group, all columns kept; a row that is there twice stays once.

    Rows without an id come after those with one. Groups are what pairs of at least `similarity` connect, the Jaccard
    similarity of their distinct shingles. Pairs to compare come from fingerprints of distinct shingles within `distance`
    bits, and from bands of smallest hashes: at a similarity of 0.8 two fingerprints differ in about 10 bits. Pairs that are still
    apart and share a leading shingle are compared after that, so none is left out (`linked_exactly`). Rows with equal shingles
    are one node throughout; null and empty texts are equal.
    """
    key = F.struct(F.col(id_column).isNull().alias("n"), F.col(id_column).alias("i"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("t"))
    rows = settle(shingle_sets(docs.select(key.alias("_key"), F.col(text_column).alias("_text")), shingle, "_key", "_text"), "shingle-sets")
    nodes = settle(rows.groupBy("digest", "fp", "bands").agg(F.min("_key").alias("_key")), "shingle-nodes")
    first = compare(fingerprint_pairs(nodes, distance).unionByName(band_pairs(nodes)), rows, similarity, "simhash")
    roots = linked_exactly(rows, first, similarity)
    placed = nodes.join(roots, nodes["digest"] == roots["node"], "left").select("_key", F.coalesce("root", "digest").alias("root"))
    kept = settle(placed.groupBy("root").agg(F.min("_key").alias("_key")).select("_key"), "simhash-kept")
    # Texts are dealt only where a row may have to go: those of no other key stay where they are.
    keys = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).join(kept.withColumn("_kept", F.lit(True)), "_key", "left")
    known = marked(keys.where("_n > 1 OR _kept IS NULL").select(F.xxhash64("_key").alias("hash")))
    # Only the kept keys are read from here on; the sets of shingles are as large as the texts.
    forget(rows, nodes)
    in_doubt = F.arrow_udf(lambda hashes: pa.array(known(hashes.to_numpy())), "boolean")
    rows = docs.select(F.struct("*").alias("row"), key.alias("_key")).withColumn("_doubt", in_doubt(F.xxhash64("_key")))
    left = rows.where("_doubt").join(kept, "_key", "left_semi")
    left = left.withColumn("_copy", F.row_number().over(Window.partitionBy("_key").orderBy("_key"))).where("_copy = 1")
    return rows.where("NOT _doubt").select("row.*").unionByName(left.select("row.*"))
