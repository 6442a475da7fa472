"""Centroid clustering (Lloyd's rounds over integers) with Ptolemaic pivots.

Distances of every vector to a few fixed pivots are computed once and cached in a
checkpoint beside the vectors.  For a pair of pivots p, s Ptolemy's inequality gives

    d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|,

so the largest quotient over all pairs is a lower bound of a vector's distance to a
centroid, without touching the vector.  The bound is computed in doubles and made
smaller by more than their rounding error; a centroid whose bound is over the best
exact distance so far is skipped, the survivors are compared exactly in integers.

A round is one job over the cached table: each task adds up its own vectors by
cluster, and one row per task and cluster is combined, so a value held by a third
of all rows costs no more than others.  The driver holds the centroids (k rows).

Defined results: vectors with another number of components, or with a null or
non-finite one, take no part; nor do those with an integer component over 2**27 in
size, whose squared distance would not fit into a long.  Ties go to the smaller
centroid number; equal start hashes (repeated ids) go by the vector; rows without an
id are clustered but start no centroid unless there are too few others.  Fewer
vectors than centroids give fewer centroids; an empty table gives an empty result.
Extra columns are left behind; repeated rows each count.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Largest integer component: 64 squares of differences of two fit into 63 bits.
LIMIT = 1 << 27
#: Relative room for rounding: a bound takes fewer than ten operations of 2**-53 each.
ROOM = 1e-12


def quantized(vectors: DataFrame, size: int = 64, scale: int = 1024, column: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as int, x taken as double."""
    x = F.col(column).cast("array<double>")
    fits = F.forall(x, lambda c: F.coalesce(F.abs(c * scale) <= LIMIT, F.lit(False)))  # NaN is over any number
    kept = vectors.where(F.col(column).isNotNull() & (F.size(column) == size)).where(fits)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows to a point."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """(p, s, distance) of all pairs of different pivots."""
    found = ((p, s, int(squared(pivots[p:p + 1], pivots[s])[0])) for p, s in combinations(range(len(pivots)), 2))
    return [(p, s, float(np.sqrt(d))) for p, s, d in found if d]


def lower_bounds(to_pivots: np.ndarray, of_centroid: np.ndarray, pairs) -> np.ndarray:
    """Lower bounds of the distance of each row (its pivot distances) to one centroid."""
    best = np.zeros(len(to_pivots))
    for p, s, gap in pairs:
        a, b = to_pivots[:, p] * of_centroid[s], to_pivots[:, s] * of_centroid[p]
        np.maximum(best, (np.abs(a - b) - ROOM * (a + b)) / gap, out=best)
    return best * (1 - ROOM)


def nearest(rows: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid number, exact squared distance) of each row, and how many distances were computed."""
    cluster, best, done = np.zeros(len(rows), np.int64), squared(rows, centroids[0]), len(rows)
    for c in range(1, len(centroids)):
        of_centroid = np.sqrt(squared(pivots, centroids[c]).astype(float))
        bound = lower_bounds(to_pivots, of_centroid, pairs)
        left = np.flatnonzero(bound * bound * (1 - ROOM) < best)  # at equality the smaller number stays
        exact = squared(rows[left], centroids[c])
        done += len(left)
        less = exact < best[left]
        cluster[left[less]], best[left[less]] = c, exact[less]
    return cluster, best, done


def choose_pivots(vectors: DataFrame, n: int, sample: int = 256) -> np.ndarray:
    """`n` vectors far from each other, of the `sample` smallest by hash (a bounded sample;
    pivots decide how much is skipped, never a result)."""
    rows = np.array([r["v"] for r in vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()], np.int64)
    if not len(rows):
        return rows
    chosen, far = [0], squared(rows, rows[0])
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(rows, rows[chosen[-1]]))
    return rows[chosen]


def _matrix(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    col = batch.column(batch.schema.names.index(name))
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(col), -1)


def with_pivot_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, to_pivots): the cached table every round reads."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                rows = _matrix(b, "v", np.int64)
                d = np.sqrt(np.stack([squared(rows, p) for p in pivots], axis=1).astype(float))
                flat = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, flat], ["vec_id", "v", "to_pivots"])

    return cut(vectors.mapInArrow(run, "vec_id long, v array<int>, to_pivots array<double>"))


def start(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of `seed:vec_id`."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def assign(cached: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    pairs = pivot_pairs(pivots)

    def run(batches):
        for b in batches:
            if b.num_rows:
                cluster, best, _ = nearest(_matrix(b, "v", np.int64), _matrix(b, "to_pivots", float), centroids, pivots, pairs)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    return cached.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(cached: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each one's vectors; empty ones stay."""
    pairs = pivot_pairs(pivots)

    def run(batches):
        sums, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            if b.num_rows:
                rows = _matrix(b, "v", np.int64)
                cluster, _, _ = nearest(rows, _matrix(b, "to_pivots", float), centroids, pivots, pairs)
                n += np.bincount(cluster, minlength=len(n))
                for c in np.unique(cluster).tolist():
                    sums[c] += rows[cluster == c].sum(axis=0)
        some = np.flatnonzero(n).tolist()
        yield pa.RecordBatch.from_pydict({"cluster": some, "n": n[some].tolist(), "s": sums[some].tolist()}, pa.schema(
            [("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]))

    rows = cached.mapInArrow(run, "cluster int, n long, s array<long>")
    wide = rows.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for r in wide.collect():  # k rows
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, n_pivots: int = 6) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) after `rounds` rounds and a last assignment.

    `vectors` is (vec_id, v) as `quantized` gives it."""
    vectors = cut(vectors)
    pivots, centroids = choose_pivots(vectors, n_pivots), start(vectors, k, seed)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids
    cached = with_pivot_distances(vectors, pivots)
    for _ in range(rounds):
        centroids = moved(cached, centroids, pivots)
    return cut(assign(cached, centroids, pivots)), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add cluster_inertia, inertia and centroid_sha256 (one value per centroid) to assigned rows."""
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    if not sums:
        return found.selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    own = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(sha))])
    return found.select("*", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"),
                        F.get(F.array(*map(F.lit, sha)), F.col("cluster")).alias("centroid_sha256"))
