import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from deltion.llm import manifest
from tests.llm.helpers import against_sql, write


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes, fan):
    """(root, path of each node as (left, right) digests) of a list of digests."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i:i + fan] for i in range(0, len(nodes), fan)]
    root, above = tree([h(*r) for r in runs], fan)
    return root, [[(r[:i], r[i + 1:]), *above[k]] for k, r in enumerate(runs) for i in range(len(r))]


def brute(rows, fan):
    """Rows of (doc_id, source, text): (doc_id, leaf, subroot, root, proof)."""
    groups = defaultdict(list)
    for d, s, t in rows:
        groups[s].append((d is not None, d or 0, h(field(d), field(s), field(t)), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fan) for s in order}
    root, above = tree([trees[s][0] for s in order], fan)
    out = []
    for k, s in enumerate(order):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            steps = path + above[k]
            out.append((x[3], x[2], trees[s][0], root, h(*(y for a, b in steps for y in a + b)), steps))
    return out


def check(spark, rows, fan):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = manifest.manifest(df, ["doc_id", "source", "text"], fan=fan).collect()
    want = brute(rows, fan)
    assert sorted(str((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256)) for r in got) == sorted(str(w[:5]) for w in want)
    assert all(r.verified for r in got)
    assert sorted(str([(p.left, p.right) for p in r.path]) for r in got) == sorted(str([("".join(a), "".join(b)) for a, b in w[5]]) for w in want)


def test_trees_of_many_sizes(spark):
    for fan, sizes in ((2, (1, 2, 3, 5, 8, 17)), (3, (1, 3, 4, 9, 10, 28)), (16, (1, 15, 16, 17, 257))):
        rows = [(i, f"s{k}" if k else None, f"text {i}") for k, n in enumerate(sizes) for i in range(n)]
        check(spark, rows, fan)
    check(spark, [(i, f"s{i:03d}", None) for i in range(40)], 3)
    check(spark, [(7, "only", "x")], 16)


def test_repeated_rows_and_nulls(spark):
    check(spark, [(None, None, None)] * 70 + [(1, "a", "")] * 3 + [(1, "a", "b"), (None, "a", "c")], 4)


def test_tampering_shows(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", "Upper" if i % 2 else "lower") for i in range(100)], "doc_id long, source string, text string")
    got = manifest.manifest(df, ["doc_id", "source", "text"], tampered=manifest.lower_ascii, tamper_where=F.col("doc_id") % 5 == 0).collect()
    assert len(got) == 100 and all(r.verified == (r.doc_id % 5 != 0 or r.doc_id % 2 == 0) for r in got)


def test_edge_rows_against_sql(spark, tmp_path):
    rows = [(i, f"Text É {i}", None if i % 3 else "en", ("a", "é", "z", None, "B")[i * i % 5], None if i % 4 else i) for i in range(600)]
    rows += [(None, None, None, None, None)] * 40 + [(5, "", "", "", 0)] * 2 + [(10 ** 12, "A" * 100_000, "en", "alone", 1)]
    assert against_sql(spark, write(spark, tmp_path / "t", documents=rows), "op13_merkle_manifest") == []
    assert against_sql(spark, write(spark, tmp_path / "e"), "op13_merkle_manifest") == []


def test_given_documents(spark):
    assert against_sql(spark, "/root/testdata/sf0.001", "op13_merkle_manifest") == []
