"""Exact integer k-means with ns-bounds.

For each vector and group of centroids a lower bound of the distances, and the round in which it was last evaluated, stay with
the vector. The centroids of all rounds are kept; a bound is loosened by the norm of the total displacement of a centroid since
that round, not by the sum of its drifts. Groups whose bound fails against the exact distance to the own centroid are scanned
again, exactly. Everything is integer arithmetic, so the result does not depend on the order of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltion.llm.shared import settle

LIMIT = 1 << 28  # components over this would overflow 64-bit squared distances of 64 components
STATE = "vec_id {kind}, v array<int>, cluster int, distance long, bounds array<int>, seen array<byte>, scans int"


def whole_vectors(table: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with `dims` components, none of them null, NaN or infinite."""
    x = F.transform(F.col("v"), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v")).where((F.size("v") == dims) & ~bad)
    safe = lambda c: F.when(F.abs(c) < LIMIT, c.cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LIMIT} or more")).cast("int"))
    return rows.select("vec_id", F.transform(x, lambda c: safe(F.floor(c * scale))).alias("v"))


def start(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hex SHA-256 of `seed:vec_id` (equal ids: smaller components first), k rows at most."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select("v", order.alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def roots(squares: np.ndarray) -> np.ndarray:
    """Integers that are not above the square roots (16ths): one less than the rounded-down double, which may be one too high."""
    return np.maximum(np.floor(np.sqrt(squares.astype(np.float64)) * 16).astype(np.int64) - 1, 0)


class Rounds:
    """The centroids of all rounds so far, and how far each has moved from each of them to the last (in 16ths, rounded up)."""

    def __init__(self, history: list[np.ndarray], per_group: int):
        self.history, self.now = history, history[-1]
        self.groups = [np.arange(i, min(i + per_group, len(self.now))) for i in range(0, len(self.now), per_group)]
        moved = np.stack([((self.now - old) ** 2).sum(1) for old in history])
        far = np.ceil(np.sqrt(moved.astype(np.float64)) * 16).astype(np.int64) + 1
        far[moved == 0] = 0
        self.moved = np.stack([far[:, g].max(1) for g in self.groups], 1)  # round x group

    def distances(self, v: np.ndarray, members: np.ndarray) -> np.ndarray:
        out = np.empty((len(v), len(members)), np.int64)
        for i, j in enumerate(members):
            step = v - self.now[j]
            out[:, i] = np.einsum("ij,ij->i", step, step)
        return out

    def assign(self, v: np.ndarray, cluster: np.ndarray, bounds: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
        """New (cluster, squared distance, bounds, round of each bound, pairs of vector and group scanned) for vectors of one batch.

        A bound holds for all centroids of its group but the own one of the vector. A group whose loosened bound is above the distance
        to the own centroid cannot hold a nearer one, nor one as near; all others are scanned. The group a vector
        leaves is scanned too, as its bound did not count the old centroid.
        """
        n, last = len(v), len(self.history) - 1
        step = v - self.now[cluster]
        best, of = np.einsum("ij,ij->i", step, step), cluster.copy()
        above = np.floor(np.sqrt(best.astype(np.float64)) * 16).astype(np.int64) + 2
        loose = bounds - self.moved[seen, np.arange(len(self.groups))]
        fails = (loose <= above[:, None]) | (bounds < 0)
        scanned = np.zeros(n, np.int64)
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def scan(g: int, rows: np.ndarray) -> None:
            d = self.distances(v[rows], self.groups[g])
            nearest = d.argmin(1)
            value, index = d[np.arange(len(rows)), nearest], self.groups[g][nearest]
            better = (value < best[rows]) | ((value == best[rows]) & (index < of[rows]))
            best[rows[better]], of[rows[better]] = value[better], index[better]
            scanned[rows] += 1
            tables[g] = (np.concatenate([tables[g][0], rows]), np.concatenate([tables[g][1], d])) if g in tables else (rows, d)

        for g in range(len(self.groups)):
            rows = np.flatnonzero(fails[:, g])
            if len(rows):
                scan(g, rows)
        left = np.flatnonzero(of != cluster)
        home = np.array([g for g, members in enumerate(self.groups) for _ in members])
        for g in range(len(self.groups)):
            rows = left[(home[cluster[left]] == g) & ~fails[left, g]]
            if len(rows):
                scan(g, rows)
        bounds, seen = bounds.copy(), seen.copy()
        for g, (rows, d) in tables.items():
            d = np.where(self.groups[g][None, :] == of[rows][:, None], np.iinfo(np.int64).max, d)
            bounds[rows, g], seen[rows, g] = np.minimum(roots(d.min(1)), np.iinfo(np.int32).max), last
        return of, best, bounds, seen, scanned


def assigned(state: DataFrame, history: list[np.ndarray], per_group: int, batch_rows: int = 4096) -> DataFrame:
    """One pass over the vectors: the state of the next round. What tasks carry is bounded by centroids times rounds."""
    names = [f.name for f in state.schema]

    def work(batches):
        rounds = Rounds(history, per_group)
        groups = len(rounds.groups)
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                v = np.asarray(batch.column(1).flatten(), np.int64).reshape(batch.num_rows, -1)
                cluster = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = np.asarray(batch.column(4).flatten(), np.int64).reshape(-1, groups)
                seen = np.asarray(batch.column(5).flatten(), np.int64).reshape(-1, groups)
                cluster, distance, bounds, seen, scanned = rounds.assign(v, cluster, bounds, seen)
                cut = pa.array(np.arange(0, bounds.size + 1, groups), pa.int32())
                columns = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.ListArray.from_arrays(cut, pa.array(bounds.ravel(), pa.int32())), pa.ListArray.from_arrays(cut, pa.array(seen.ravel(), pa.int8())), pa.array(scanned, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return state.mapInArrow(work, state.schema)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of the vectors of each cluster; an empty one stays. Exact sums, added up in two steps."""
    dims = centroids.shape[1]
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(dims)]
    parts = state.select("cluster", (F.spark_partition_id() % 64).alias("salt"), *(F.get("v", F.lit(i)).cast("long").alias(f"s{i}") for i in range(dims)))
    parts = parts.groupBy("cluster", "salt").agg(F.count(F.lit(1)).alias("n"), *sums)
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # a row for each centroid at most
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(dims)]
    return out


def cluster(table: DataFrame, k: int, rounds: int, dims: int, scale: int = 256, seed: str = "2", per_group: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, list[np.ndarray], list[DataFrame]]:
    """The assignment (vec_id, v, cluster, distance, ...) after `rounds` rounds, the centroids of all rounds and the state of each pass.

    Vectors of another length, or with a null, NaN or infinite component, are left out; a null id counts as an empty one and
    repeated rows are vectors of their own. With fewer than k vectors there are as many centroids; with none, no rows.
    Components of 2**28 or more (after scaling) raise an error, as squared distances would not fit 64 bits.
    Every pass reads the state of the one before from a written table.
    """
    vectors = settle(whole_vectors(table, dims, scale, id_column, vector_column), "vectors")
    history = [start(vectors, k, seed)]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = STATE.format(kind=kind)
    if not len(history[0]):
        return table.sparkSession.createDataFrame([], schema), history, []
    groups = -(-len(history[0]) // per_group)
    state, states = vectors.selectExpr("vec_id", "v", "0 AS cluster", "0L AS distance", f"array_repeat(-1, {groups}) AS bounds", f"array_repeat(CAST(0 AS BYTE), {groups}) AS seen", "0 AS scans"), []
    for round_ in range(rounds + 1):
        state = settle(assigned(state, history, per_group), f"centroids-{round_}")
        states.append(state)
        if round_ < rounds:
            history.append(means(state, history[-1]))
    return state, history, states


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def report(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    names = F.array(*(F.lit(digest(c)) for c in centroids)) if len(centroids) else F.array(F.lit(""))
    sums = [(r.cluster, r.total) for r in state.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()]  # a row for each centroid at most
    of: Column = F.create_map(*(F.lit(x).cast("int" if i % 2 == 0 else "long") for pair in sums for i, x in enumerate(pair))) if sums else F.create_map(F.lit(0), F.lit(0).cast("long"))
    return state.select("vec_id", "cluster", "distance", F.try_element_at(of, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(x for _, x in sums)).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"))
