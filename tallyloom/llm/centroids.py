"""Centroid clustering by sort-means, in exact integers.

Components become integers floor(SCALE * x). In each round the other centroids are ordered by their distance from each centroid.
A vector starts from its previous centroid (in the first round from number 0) and looks at the others in that order; those
strictly farther from the previous centroid than twice the vector is cannot be nearer, nor as near with a smaller number, and end
the scan. Squared distances are compared, so four times. The vectors of an Arrow batch with the same previous
centroid are scanned together, fewer at each step.

A round is one pass over the vectors, written with their new centroid, and one that sums them: each task sends one row a
batch and cluster. The driver holds the centroids only (clusters * DIMENSIONS numbers).

Defined results: vectors with another number of components, or with a component that is null or not finite, are left
out. Integers beyond plus or minus 2 ** 27 count as that, so that no distance exceeds 64 bits. Of equal hashes (repeated
vec_ids) the least vector is the earlier start; a vector without a vec_id has no hash and is no start unless too few others are there. Equal
distances go to the smaller number. Fewer vectors than clusters: that many clusters; none: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm.scratch import Scratch

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
SEED = 2
FURTHEST = 1 << 27


def whole_vectors(rows: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integers of each vector that counts."""
    x = rows[vector].cast("array<double>")
    fine = F.size(x) == dimensions
    fine = fine & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    bound = lambda e: F.greatest(F.lit(-FURTHEST), F.least(F.lit(FURTHEST), F.floor(e * scale))).cast("int")
    clipped = F.transform(x, lambda e: bound(F.greatest(F.lit(-1e9), F.least(F.lit(1e9), e))))
    return rows.filter(fine).select(rows["vec_id"].cast("long").alias("vec_id"), clipped.alias("v"))


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    flat = batch["v"]
    return flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() : flat.offsets[-1].as_py()].reshape(-1, dimensions).astype(np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row of x."""
    apart = np.array([_squared(centroids, c) for c in centroids])
    order = np.argsort(apart, axis=1, kind="stable")
    best, least = previous.copy(), np.empty(len(x), np.int64)
    for start in np.unique(previous):
        rows = np.flatnonzero(previous == start)
        own = _squared(x[rows], centroids[start])
        number, shortest = np.full(len(rows), start), own.copy()
        at = np.arange(len(rows))  # the rows still scanned
        for other in order[start]:
            if other == start:
                continue
            at = at[apart[start, other] <= 4 * own[at]]
            if not len(at):
                break
            d = _squared(x[rows[at]], centroids[other])
            nearer = (d < shortest[at]) | ((d == shortest[at]) & (other < number[at]))
            number[at[nearer]], shortest[at[nearer]] = other, d[nearer]
        best[rows], least[rows] = number, shortest
    return best, least


def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, least = nearest(_matrix(batch, shared.value.shape[1]), batch["cluster"].to_numpy().astype(np.int64), shared.value)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(number, pa.int32()), pa.array(least)], ["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster").mapInArrow(assign, "vec_id long, v array<int>, cluster int, distance long")


def _sums(rows: DataFrame, dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """Count and sums of components of each cluster."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _matrix(batch, dimensions), batch["cluster"].to_numpy()
            order = np.argsort(own, kind="stable")
            numbers, first, n = np.unique(own[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[order], first, axis=0) if len(x) else np.zeros((0, dimensions), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(n, pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = rows.select("v", "cluster").mapInArrow(add, "cluster int, n long, s array<bigint>")
    total = lambda k: F.sum(F.get("s", F.lit(k)).cast("decimal(28,0)"))
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*map(total, range(dimensions))).alias("s"))
    return {x.cluster: (x.n, [int(y) for y in x.s]) for x in found.collect()}  # one row a cluster


def cluster(rows: DataFrame, vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of rows (vec_id, vector) that counts."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "centroids")
    points = scratch.keep(whole_vectors(rows, vector, dimensions, scale).withColumn("cluster", F.lit(0)), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = points.select("v", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()  # as many vectors as there are clusters
    centroids = np.array([x.v for x in starts], np.int64).reshape(-1, dimensions)
    if not len(centroids):
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        moved = scratch.keep(_assigned(points, centroids), "round")
        scratch.drop(points)
        points = moved
        for number, (n, sums) in _sums(points, dimensions).items():
            centroids[number] = [s // n for s in sums]  # floors
    points = scratch.keep(_assigned(points, centroids).drop("v"), "assigned")
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    own = points.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    own = own.withColumn("all", F.sum("s").over(Window.partitionBy()))  # of a row a cluster
    own = own.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    own = own.select("cluster", F.col("s").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"), "centroid_sha256")
    return points.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
