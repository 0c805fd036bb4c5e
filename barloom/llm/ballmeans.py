"""Exact k-means with clusters as balls.

A cluster is a ball: its centroid and a radius that no member's distance exceeds. Another centroid can only win a member
if it is nearer than twice the radius; such centroids are the ball's neighbours. In order of the neighbours' distance the
ball falls into a stable core, closer than half way to the nearest neighbour, where members stay without a comparison, and
annuli: a member of the k-th annulus is compared with the k nearest neighbours alone. By the triangle inequality nothing
else can be nearer, so the clusters are those of comparing every vector with every centroid.

Components are integers, and so are distances, sums and centroids: the result doesn't depend on partitions or order.
A round is one job over vectors that stay where they are; what it moves are a row of sums for each cluster and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import dropped, stored

#: Vectors that are compared with the same neighbours at once.
BLOCK = 256


def widest(dims: int) -> int:
    """The largest absolute component with which squared distances fit into a long."""
    return min((1 << 30) - 1, isqrt(((1 << 62) - 1) // max(1, dims)) // 2)


def integers(rows: DataFrame, scale: int, id_col: str, vector_col: str, dims: int | None, others: tuple[str, ...] = ()) -> DataFrame:
    """(id, v array<int>: floor(scale * x), others) of the vectors without null or non-finite components, of `dims` ones
    if given. Components beyond `widest` are an error."""
    x = F.col("x")
    sound = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    found = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"), *[F.col(c).alias(c) for c in others]).where(x.isNotNull() & sound)
    if dims is not None:
        found = found.where(F.size(x) == dims)
    found = found.select("id", F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"), *others)
    most = widest(dims or 1024)
    fits = F.forall("v", lambda c: c.between(-most, most))
    return found.select("id", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"a component is beyond {most} after scaling"))).cast("array<int>").alias("v"), *others)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


class Balls:
    """Centroids, bounds of their radii, and for each its neighbours in order of distance."""

    def __init__(self, centroids: np.ndarray, radii: list[float]):
        self.centroids = centroids
        self.near, self.halves = [], []
        for i, radius in enumerate(radii):
            gaps = ((centroids - centroids[i]) ** 2).sum(axis=1)
            order = np.argsort(gaps, kind="stable")
            order = order[(order != i) & (gaps[order] <= 4.0 * radius * radius * (1 + 1e-9) + 1)]
            self.near.append(order)
            # (gap + 3) // 4 <= d  is  gap <= 4 d  in whole numbers, without overflow.
            self.halves.append((gaps[order] + 3) // 4)

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid to each row of `x`, which is in the ball `own`."""
        most = max((int(np.abs(m).max()) for m in (x, self.centroids) if m.size), default=0)
        # Sums below 2 ** 53 are exact in doubles, which multiply faster.
        kind = np.float64 if x.shape[1] * (2 * most) ** 2 < 1 << 53 else np.int64
        x, c = x.astype(kind), self.centroids.astype(kind)
        best, distance = own.copy(), ((x - c[own]) ** 2).sum(axis=1)
        for i in np.unique(own).tolist():
            rows = np.flatnonzero(own == i)
            annulus = np.searchsorted(self.halves[i], distance[rows], side="right")
            rows, annulus = rows[annulus > 0], annulus[annulus > 0]  # the others are in the stable core
            order = np.argsort(annulus, kind="stable")
            rows, annulus = rows[order], annulus[order]
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                tried = np.sort(np.append(self.near[i][: annulus[at : at + BLOCK][-1]], i))
                near = c[tried]
                d = (x[part] ** 2).sum(axis=1)[:, None] + (near**2).sum(axis=1) - 2 * (x[part] @ near.T)
                first = d.argmin(axis=1)  # of equal ones the smallest number
                best[part], distance[part] = tried[first], d[np.arange(len(part)), first]
        return best, distance.astype(np.int64)


def _assigning(balls: Balls) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = balls.assign(matrix(batch["v"]), batch["cluster"].to_numpy())
                yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    return run


def clusters(rows: DataFrame, k: int, rounds: int, scale: int = 256, dims: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dims` finite components.

    A component x becomes floor(scale * x). Centroids start as the `k` vectors with the smallest SHA-256 of `seed:id`
    (equal ids by vector, null ids last); with fewer vectors there are fewer. Each round assigns vectors to the nearest
    centroid, ties to the smaller number, and moves centroids to the floor of their vectors' mean; empty ones stay. Then
    vectors are assigned once more. Null vectors, those of other lengths or with null or non-finite components are left
    out; repeated rows count as often as they come. Without vectors there are no rows. Components over `widest(dims)`
    raise. Other columns are left out, whatever their names.

    k and dims bound what is broadcast and comes to the driver: k rows of dims sums a round.
    """
    spark = rows.sparkSession
    now, folder = stored(integers(rows, scale, id_col, vector_col, dims).select("id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = np.array([r["v"] for r in now.orderBy(order.asc_nulls_last(), "v").select("v").limit(k).collect()], np.int64).reshape(-1, dims)
    radii = [float("inf")] * len(centroids)
    kind = now.schema
    for last in [False] * rounds + [True]:
        before = folder
        now, folder = stored(now.mapInArrow(_assigning(Balls(centroids, radii)), kind))
        dropped(spark, before)
        if not last:
            sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
            moved, radii = centroids.copy(), [0.0] * len(centroids)
            for r in now.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():  # one row for each centroid at most
                i = r["cluster"]
                moved[i] = [r[f"s{j}"] // r["n"] for j in range(dims)]
                # No member is further from the new centroid than from the old one and what that has moved.
                radii[i] = float(r["far"]) ** 0.5 + float(((moved[i] - centroids[i]) ** 2).sum()) ** 0.5
            centroids = moved
    totals = now.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row for each centroid at most
    inertia = sum(r["cluster_inertia"] for r in totals)
    names = [(r["cluster"], r["cluster_inertia"], inertia, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in totals]
    known = spark.createDataFrame(names, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return now.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
