import hashlib
import random

import numpy as np
import pytest

from deltion.llm import centroids
from tests.llm.helpers import against_sql, write_vectors


def brute(vectors, k, rounds):
    """Plain exact k-means over (id, integer components)."""
    order = sorted(vectors, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in vectors]
        for j in range(len(c)):
            own = [v for (_, v), a in zip(vectors, at) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, *near(v)[::-1]) for i, v in vectors], c


@pytest.mark.parametrize("seed,n,k,per_group", [(1, 300, 7, 3), (2, 500, 12, 5), (3, 90, 40, 1), (4, 5, 9, 2), (5, 400, 6, 6)])
def test_small_cases_against_plain_rounds(spark, seed, n, k, per_group):
    r = random.Random(seed)
    base = [[r.randint(-3, 3) for _ in range(4)] for _ in range(9)]
    rows = [(i, [float(x + r.randint(-1, 1)) / 2 for x in base[i % 9]]) for i in range(n)]
    rows += [rows[3]] * 5 + [(None, rows[0][1])] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    state, history, states = centroids.cluster(table, k=k, rounds=4, dims=4, scale=2, per_group=per_group)
    want, last = brute([(i, [int(x * 2) for x in v]) for i, v in rows], k, 4)
    assert sorted(map(str, want)) == sorted(str((x.vec_id, x.cluster, x.distance)) for x in state.collect())
    assert history[-1].tolist() == last and len(history) == 5 and len(states) == 5


def test_bounds_spare_scans_and_use_total_displacement(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    _, history, states = centroids.cluster(table, k=40, rounds=5, dims=64)
    scans = [s.agg({"scans": "sum"}).first()[0] for s in states]
    assert scans[0] == 8 * table.count() and scans[-1] < scans[0]
    back = centroids.Rounds([history[0], history[1], history[0]], 5)
    assert back.moved[0].tolist() == [0] * 8 and back.moved[1].max() > 0


def test_edge_rows_against_sql(spark, tmp_path):
    r = np.random.default_rng(0)
    good = [(i, r.normal(size=64).astype("float32").tolist(), 0) for i in range(120)]
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 63, 0), (903, [float("nan")] + [0.0] * 63, 0), (904, [float("inf")] * 64, 0), (905, [None] + [1.0] * 63, 0), (None, [0.5] * 64, None)]
    assert against_sql(spark, write_vectors(spark, tmp_path / "t", good + odd + good[:9]), "op12_ns_bounds") == []
    assert against_sql(spark, write_vectors(spark, tmp_path / "few", good[:5] + odd), "op12_ns_bounds") == []
    assert against_sql(spark, write_vectors(spark, tmp_path / "same", good[:1] * 100), "op12_ns_bounds") == []
    assert against_sql(spark, write_vectors(spark, tmp_path / "none", odd[:6]), "op12_ns_bounds") == []


def test_given_vectors(spark):
    assert against_sql(spark, "/root/testdata/sf0.001", "op12_ns_bounds") == []


def test_too_large_components_raise(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="268435456"):
        centroids.cluster(table, k=1, rounds=1, dims=2)
