"""Centroid clustering in whole numbers: Lloyd's rounds with an annulus search for the nearest centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, left, written

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Components of this size or more are too large: with them a squared distance may not fit 64 bits.
MOST = 1 << 26
#: Pairs of a vector and a candidate compared at a time.
PAIRS = 1 << 16


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Annulus:
    """Nearest centroids, of those alone whose norm is as near as a vector's upper bound allows."""

    def __init__(self, centroids: np.ndarray) -> None:
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted, self.centroids = norms[self.order], centroids[self.order], centroids
        self.compared = 0

    def nearest(self, x: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row; ties go to the smaller number.

        The upper bound is the distance to the ``guess``, or to the centroid with the nearest
        norm. A centroid at most that far has a norm within it of the vector's, by the triangle
        inequality, so two binary searches give all that may be nearest. The annulus is closed
        and a little wider than rounding needs, so that candidates on its edge, ties among them,
        are in; all are compared in whole numbers.
        """
        k = len(self.norms)
        own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        if guess is None:
            at = np.clip(np.searchsorted(self.norms, own), 1, max(k - 1, 1))
            low = at - 1
            at = np.minimum(at, k - 1)
            guess = self.order[np.where(own - self.norms[low] <= self.norms[at] - own, low, at)]
        bound = np.sqrt(squared(x, self.centroids[guess]).astype(np.float64))
        slack = 1e-9 * (own + bound + 1)
        lo = np.searchsorted(self.norms, own - bound - slack, side="left")
        hi = np.searchsorted(self.norms, own + bound + slack, side="right")
        where, dist = np.empty(len(x), dtype=np.int32), np.empty(len(x), dtype=np.int64)
        step = max(1, PAIRS // k)
        for a in range(0, len(x), step):
            n = (hi - lo)[a : a + step]
            first = np.cumsum(n) - n
            row = np.repeat(np.arange(len(n)), n)
            candidate = np.arange(int(n.sum())) - np.repeat(first - lo[a : a + step], n)
            d = squared(x[a : a + step][row], self.sorted[candidate])
            best = np.minimum.reduceat(d, first)
            number = np.where(d == best[row], self.order[candidate], k)
            where[a : a + step], dist[a : a + step] = np.minimum.reduceat(number, first), best
            self.compared += len(row)
        return where, dist


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids).

    Kept are vectors of ``dims`` components, none null or not finite; each component becomes
    floor(scale * x). Centroids 0, 1, ... start as the ``k`` kept vectors whose SHA-256 of
    ``<seed>:<id>`` is smallest, in its ascending order. Each round moves every vector to its
    nearest centroid, then every centroid that has some to their floored mean; at the end all
    are moved once more.

    Null ids hash as an empty id, and ids that repeat are ordered by their components (rows that
    are alike in both may give equal centroids, of which the smaller number takes all). Vectors
    with a component of 2^26 / scale or more in size are left out, since their distances do not
    fit a long. Fewer than ``k`` vectors give as many centroids; none give no rows. Other columns
    are ignored.

    Vectors stay where they are: they are written once, as whole numbers with the cluster of the
    first round, whose present centroid bounds later searches. Each task adds up its vectors by
    cluster, so at most ``k`` sums a task are shuffled; what reaches the driver and is sent to
    the tasks are ``k`` vectors.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    whole = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(MOST / scale)))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(whole)
    # (an array as F.transform makes it: floor of a double is a long)
    kept = kept.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.select(key.alias("key"), "vec_id", "v").orderBy("key", "vec_id", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), dims)
    if not len(start):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), centroids

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for b in batches:
            where, _ = search.nearest(_vectors(b.column(1), dims).astype(np.int64)) if b.num_rows else (np.empty(0, np.int32), None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where, pa.int32())], names=["vec_id", "v", "guess"])

    rows, path = written(kept.mapInArrow(first, "vec_id long, v array<int>, guess int"), "vectors")

    def sums(by: np.ndarray, x: np.ndarray, total: np.ndarray, count: np.ndarray) -> None:
        np.add.at(count, by, 1)
        order = np.argsort(by, kind="stable")
        which, at = np.unique(by[order], return_index=True)
        total[which] += np.add.reduceat(x[order], at, axis=0)

    def moved(now: np.ndarray, given: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search, total, count = Annulus(now), np.zeros((len(now), dims), dtype=np.int64), np.zeros(len(now), dtype=np.int64)
            for b in batches:
                if b.num_rows:
                    x, guess = _vectors(b.column(0), dims).astype(np.int64), b.column(1).to_numpy()
                    sums(guess if given else search.nearest(x, guess)[0], x, total, count)
            some = np.nonzero(count)[0]
            for c in some:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(dims, c, np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(total[c]), pa.array(np.full(dims, count[c]))], names=["cluster", "at", "total", "n"]
                )

        return run

    for r in range(rounds):
        part = rows.select("v", "guess").mapInArrow(moved(centroids, r == 0), "cluster int, at int, total long, n long")
        got = part.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        centroids = centroids.copy()
        for s in got:
            centroids[s["cluster"], s["at"]] = int(s["total"]) // s["n"]
    final = centroids

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(final)
        for b in batches:
            if b.num_rows:
                where, dist = search.nearest(_vectors(b.column(1), dims).astype(np.int64), b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(where, pa.int32()), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    out, out_path = written(rows.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters")
    dropped(spark, path)
    left(out_path)
    return out, final


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components) of every kept vector; see ``clustered``.

    Repeated rows and null ids get a row each.
    """
    out, final = clustered(vectors, id_col, vector_col, **how)
    spark = vectors.sparkSession
    each = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # k rows
    inertia = {r["cluster"]: int(r["total"]) for r in each}
    stats = [(c, inertia[c], sum(inertia.values()), [int(x) for x in final[c]]) for c in sorted(inertia)]
    known = spark.createDataFrame(stats, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
