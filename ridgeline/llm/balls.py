"""Exact centroid clustering of integer vectors by ball k-means.

A cluster is a ball: its centroid and the distance of its farthest member. Only clusters whose centroids lie within
twice that radius can take a member over; they are its neighbours. Members nearer to their centroid than half the way to the
nearest neighbour are the ball's stable core and stay. The others lie in annuli, cut at half the distance of each
neighbour in turn, and are compared with as many neighbours as their annulus says. All decisions are in integers, ties
included, so the result is that of comparing all with all."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Stored

#: Components are held to this size, so that squared distances of up to 64 of them fit in 64 bits.
MOST = 1 << 27


@dataclass
class Balls:
    """Centroids (k x d), and per cluster its neighbours in order of distance with the least squared distance of a member
    at which each can matter."""

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    reach: list[np.ndarray]

    @classmethod
    def of(cls, centroids: np.ndarray, radii: np.ndarray | None = None) -> Balls:
        """``radii``: no member is farther from its centroid (None: unknown). x is as near to c_j as to its own c_i only
        if |x - c_i| is at least half |c_i - c_j|, or 4 |x - c_i|^2 >= |c_i - c_j|^2."""
        neighbours, reach = [], []
        for i, c in enumerate(centroids):
            square = ((centroids - c) ** 2).sum(axis=1)
            near = np.ones(len(square), bool) if radii is None else np.sqrt(square.astype(float)) <= 2 * radii[i] * (1 + 1e-9)
            near[i] = False
            order = np.flatnonzero(near)
            order = order[np.argsort(square[order], kind="stable")]
            neighbours.append(order)
            reach.append((square[order] + 3) // 4)
        return cls(centroids, neighbours, reach)

    def nearest(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each row of ``x``, whose clusters were ``home``; the smallest number among equals.
        Third, how many distances were computed."""
        cluster, distance, n = home.copy(), np.zeros(len(x), np.int64), 0
        for i in np.unique(home):
            at = np.flatnonzero(home == i)
            own = ((x[at] - self.centroids[i]) ** 2).sum(axis=1)
            annulus = np.searchsorted(self.reach[i], own, side="right")  # 0: the stable core
            best, to, n = own.copy(), np.full(len(at), i), n + len(at)
            for m, j in enumerate(self.neighbours[i][: annulus.max()]):
                outer = np.flatnonzero(annulus > m)
                d, n = ((x[at[outer]] - self.centroids[j]) ** 2).sum(axis=1), n + len(outer)
                better = (d < best[outer]) | ((d == best[outer]) & (j < to[outer]))
                best[outer[better]], to[outer[better]] = d[better], j
            cluster[at], distance[at] = to, best
        return cluster, distance, n


def quantised(vectors: DataFrame, dim: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(id, q): floor(scale * x) of every component x of the vectors with ``dim`` components, none null or non-finite;
    other rows go. Components beyond ``MOST`` either way are taken as that."""
    base = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("v"))
    base = base.where(F.col("v").isNotNull() & (F.size("v") == dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls as NaN
            good = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(x[good] * scale), -MOST, MOST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), _lists(q)], ["id", "q"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, q array<int>")


def _lists(q: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * q.shape[1], pa.array(q.ravel(), pa.int32()))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def assign(members: DataFrame, balls: Balls) -> DataFrame:
    """``members`` (id, q, cluster, distance) at their nearest centroids."""
    dim = balls.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = balls.nearest(_rows(batch.column("q"), dim), batch.column("cluster").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "q", "cluster", "distance"])

    return members.mapInArrow(run, members.schema)


def totals(members: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """(sums of components, counts, sums of distances, largest distance) of the k clusters, exact. A task adds up its own
    rows, so k * (dim + 3) numbers a task are combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, most = np.zeros((k, dim + 3), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            q, c, d = _rows(batch.column("q"), dim), batch.column("cluster").to_numpy(zero_copy_only=False), batch.column("distance").to_numpy(zero_copy_only=False)
            for i in np.unique(c):
                at = c == i
                # distances in halves of 32 bits, whose sums can't overflow
                sums[i] += np.array([*q[at].sum(axis=0), at.sum(), (d[at] & 0xFFFFFFFF).sum(), (d[at] >> 32).sum()])
                most[i] = max(most[i], d[at].max())
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j]), pa.array(most[i])], ["cluster", "at", "v", "most"])

    found = members.mapInArrow(run, "cluster int, at int, v long, most long").groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.max("most").alias("most"))
    sums, most = np.zeros((k, dim + 3), object), np.zeros(k, np.int64)
    for r in found.collect():
        sums[r["cluster"], r["at"]] = int(r["v"])
        most[r["cluster"]] = max(most[r["cluster"]], r["most"])
    return sums[:, :dim], sums[:, dim], [int(x) for x in sums[:, dim + 1] + sums[:, dim + 2] * (1 << 32)], most


def ball_kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: str = "1:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dim`` finite components.

    Centroids begin as the k vectors with the smallest sha256 of seed and id (fewer vectors: fewer centroids), repeated
    ids in order of their vectors; a null id is empty there. Each of ``rounds`` assigns all vectors (equal distances: the
    smaller number) and moves non-empty centroids to floor(sum / count) of their vectors; then all are assigned once
    more. Vectors of other lengths, null ones and those with a null or non-finite component go; repeated rows are
    vectors of their own; an empty table gives an empty table. Inertias beyond 64 bits are null.

    A round reads the table that the last one stored (vectors, their cluster and distance) and brings k * dim numbers to
    the driver. How far a centroid moved is added to its ball's radius, so neighbours are known before the next pass."""
    store = Stored(vectors.sparkSession, "balls")
    points, path = store.put(quantised(vectors, dim, scale, id_col, vec_col).select("id", "q", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = points.select("q", order.alias("h")).orderBy("h", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, dim)
    radii = None
    for left in range(rounds, -1, -1):
        if not len(centroids):
            break
        before = path
        points, path = store.put(assign(points, Balls.of(centroids, radii)))
        store.drop(before)
        sums, counts, inertias, most = totals(points, len(centroids), dim)
        if left:
            moved = np.array([[int(x) // int(n) for x in s] if n else c for s, n, c in zip(sums, counts, centroids, strict=True)], np.int64)
            radii = np.sqrt(most.astype(float)) + np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(float))
            centroids = moved
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(i, fits(inertias[i]), fits(sum(inertias)), digests[i]) for i in range(len(centroids))]
    balls = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return points.select(F.col("id").alias(id_col), "cluster", "distance").join(F.broadcast(balls), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
