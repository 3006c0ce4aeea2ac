import random

import numpy as np
import xxhash

from deltion.llm import simhash
from tests.llm.helpers import write


def brute_fingerprint(text, k):
    words = "".join(c if c not in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c.lower() for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def brute_components(fps: dict, distance: int) -> dict:
    label = {f: f for f in fps}
    root = lambda f: f if label[f] == f else root(label[f])
    ordered = list(fps)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= distance:
                label[max(root(a), root(b))] = min(root(a), root(b))
    groups: dict = {}
    for f, ids in fps.items():
        groups.setdefault(root(f), []).extend(ids)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return {f: least[root(f)] for f in fps}


def check(rows, texts, k, distance):
    fps: dict = {}
    for i, t in texts:
        fps.setdefault(brute_fingerprint(t, k), []).append(i)
    comp = brute_components(fps, distance)
    want = sorted(((i, f"{brute_fingerprint(t, k):016x}", comp[brute_fingerprint(t, k)]) for i, t in texts), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want


def test_query_equals_brute_force(spark, tmp_path):
    from deltion.llm.queries import op3_simhash_gray

    base = " ".join(f"w{i}" for i in range(300))
    texts = [(1, None), (2, ""), (3, " \t\r\n"), (4, "One"), (5, "one two"), (6, "ONE two"), (7, "one two three"), (8, "É a\x1fb c é"), (9, base), (10, base + " x"), (11, base.upper()), (11, base), (None, base), (None, "alone"), (12, "a " * 40000)]
    texts += [(20 + i, " ".join(w if j != i * 7 else "changed" for j, w in enumerate(base.split()))) for i in range(20)]
    folder = write(spark, tmp_path / "t", documents=[(i, t, None, None, 0) for i, t in texts])
    check(op3_simhash_gray(spark, folder).collect(), texts, 3, 2)
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(op3_simhash_gray(spark, "/root/testdata/sf0.001").collect(), given, 3, 2)
    assert op3_simhash_gray(spark, write(spark, tmp_path / "e")).collect() == []


def clustered(n: int, seed: int) -> list[int]:
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            out.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


def test_index_finds_every_link():
    for n, distance in ((1, 2), (2, 2), (17, 3), (700, 2), (1500, 5)):
        fps = np.array(clustered(n, n), np.uint64)
        index = simhash.GrayIndex(fps)
        found = {(int(index.fps[a]), int(index.fps[b])) for i, j in index.links(distance) for a, b in zip(i, j, strict=True)}
        pairs = {frozenset((a, b)) for i, a in enumerate(fps.tolist()) for b in fps.tolist()[:i] if (a ^ b).bit_count() <= distance}
        assert {frozenset(p) for p in found} == pairs and len(found) == len(pairs)


def test_large_cells_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rng, top = random.Random(2), 0xABCDEF << 40
    fps = sorted(set(clustered(300, 9)) | {top | rng.getrandbits(12) for _ in range(200)})
    ids = {f: [i] for i, f in enumerate(fps)}
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"), 2)).collect()}
    mine, want = {}, {}
    for f in fps:
        mine.setdefault(roots.get(simhash.signed(f), simhash.signed(f)), set()).add(f)
    for f, c in brute_components(ids, 2).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 400)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)} | {(500, 400)}


def jaccard(a, b, k=5):
    one, other = ({tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(one & other) / len(one | other)


def test_forest_connects_as_links_do():
    for n, distance in ((2, 2), (700, 2), (1500, 5)):
        fps = clustered(n, n)
        edges = list(zip(*(x.tolist() for x in simhash.forest(np.array(fps, np.uint64), distance)), strict=True))
        assert all(a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance for a, b in edges)
        groups = set(brute_components({f: [f] for f in fps}, distance).values())
        assert len(edges) == n - len(groups)  # as many as a spanning forest has


def test_a_repeated_line_does_not_make_copies(spark):
    rng = random.Random(3)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = " home products news about contact" * 60
    docs = [(i, own(240) + line) for i in range(40)] + [(100, None), (101, ""), (102, "One"), (103, "one")]
    text = own(300).split()
    docs += [(200, " ".join(text)), (201, " ".join([*text[:290], *own(10).split()]))]
    assert jaccard(docs[0][1], docs[1][1]) < 0.03 and jaccard(docs[-2][1], docs[-1][1]) > 0.9
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {*range(40), 100, 102, 200}


def test_copies_at_a_similarity_of_four_fifths_meet(spark):
    rng, docs, pairs = random.Random(5), [], []
    while len(pairs) < 120:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(80, 400))]
        changed = [w if rng.random() > 0.03 else f"x{rng.randrange(10**6)}" for w in words]
        if 0.8 <= jaccard(" ".join(words), " ".join(changed)) < 0.85:
            pairs.append((len(docs), len(docs) + 1))
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(changed))]
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {a for a, _ in pairs} <= kept and sum(b not in kept for _, b in pairs) >= 0.95 * len(pairs)
