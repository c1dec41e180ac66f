"""Centroid clustering in whole numbers, assigned by Orchard's search.

Every centroid has the list of the other centroids by rising distance from it. A vector starts at some centroid and walks down that
centroid's list; as soon as a centroid on it is nearer, it jumps to that one's list. Centroids it has looked at are marked and not looked at
again. It stops where the next centroid lies strictly beyond twice its present distance from the owner of the list: by the triangle
inequality, that one and all after it are farther away than the owner. At exactly twice the distance a centroid may still tie, so it is looked at.

All distances are squared and whole, so ties are true ties (the smaller number wins) and sums do not depend on the order of the rows. A round
is one pass over the stored vectors in tasks, which returns one row of sums per cluster and task; the sums meet in a grouped aggregation, and
k centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleanlake.core import c
from cleanlake.llm.common import arrow_rows, stored

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
LARGEST = 1 << 26              # components beyond this would not leave whole 64-bit distances exact
BATCH = 4_096                  # vectors searched at once; marks take BATCH * k bytes


@dataclass(frozen=True)
class Lists:
    """Centroids, and per centroid the numbers and squared distances of the others by rising distance."""
    centers: np.ndarray
    order: np.ndarray
    apart: np.ndarray

    @staticmethod
    def of(centers: np.ndarray) -> "Lists":
        k = len(centers)
        order, apart = np.zeros((k, k - 1), np.int64), np.zeros((k, k - 1), np.int64)
        for i in range(k):                                  # one row at a time: k * dims numbers
            d = ((centers - centers[i]) ** 2).sum(axis=1)
            by = np.lexsort((np.arange(k), d))
            by = by[by != i]
            order[i], apart[i] = by, d[by]
        return Lists(centers, order, apart)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def search(lists: Lists, vectors: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every vector (ties: the smaller number), its squared distance, and the number of distances computed.

    Without `start`, every vector begins at the nearest of about sqrt(k) evenly numbered centroids.
    """
    centers, k, n = lists.centers, len(lists.centers), len(vectors)
    seen = np.zeros((n, k), bool)
    rows = np.arange(n)
    if start is None:
        first = np.arange(0, k, max(1, int(k ** 0.5)))
        owner, best = np.full(n, first[0]), _distance(vectors, centers[first[0]][None, :])
        for f in first[1:]:
            d = _distance(vectors, centers[f][None, :])
            owner, best = np.where(d < best, f, owner), np.minimum(d, best)
        seen[:, first] = True
        looked = n * len(first)
    else:
        owner, looked = start.copy(), n
        best = _distance(vectors, centers[owner])
        seen[rows, owner] = True
    nearest, place, active = owner.copy(), np.zeros(n, np.int64), rows
    while len(active):
        active = active[place[active] < k - 1]
        spot = owner[active], place[active]
        go = lists.apart[spot] <= 4 * best[active]          # squares: not beyond twice the distance
        active = active[go]
        candidate = lists.order[spot][go]
        place[active] += 1
        new = ~seen[active, candidate]
        at, candidate = active[new], candidate[new]
        looked += len(at)
        seen[at, candidate] = True
        d = _distance(vectors[at], centers[candidate])
        tie = (d == best[at]) & (candidate < nearest[at])
        nearest[at[tie]] = candidate[tie]                   # as near as the owner: its list serves on
        closer = d < best[at]
        jump = at[closer]
        owner[jump] = nearest[jump] = candidate[closer]
        best[jump], place[jump] = d[closer], 0
    return nearest, best, looked


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: floor(scale * x) of the components of every vector of `dims` components, none of them null, non-finite or, scaled, beyond LARGEST."""
    x = c(vector_col).cast("array<double>")
    good = (F.size(x) == dims) & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) * F.lit(float(scale)) < F.lit(float(LARGEST))))
    rows = vectors.select(c(id_col).alias("vec_id"), x.alias("x")).where(F.coalesce(good, F.lit(False)))
    return rows.select("vec_id", F.transform("x", lambda a: F.floor(a * F.lit(float(scale))).cast("int")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _sums(lists: Lists):
    """One row per cluster of a task: the number of its vectors and the sums of their components."""
    def run(batches):
        k, dims = lists.centers.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            near, _, _ = search(lists, v)
            order = np.argsort(near, kind="stable")
            cut = np.flatnonzero(np.diff(near[order], prepend=-1))
            if len(cut):
                total[near[order][cut]] += np.add.reduceat(v[order], cut)
                count += np.bincount(near, minlength=k)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])
    return run


def _assigned(lists: Lists):
    def run(batches):
        for batch in batches:
            near, best, _ = search(lists, _matrix(batch.column("v"), lists.centers.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array(best)], names=["vec_id", "cluster", "distance"])
    return run


def starting(rows: DataFrame, k: int = CLUSTERS, seed: str = "3") -> np.ndarray:
    """The k rows with the smallest lower-case hex SHA-256 of `seed:vec_id`. Rows without identifier start nothing; repeated identifiers go by their components."""
    key = F.sha2(F.concat(F.lit(seed + ":"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def moved(rows: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floors of the means of their vectors; a centroid without vectors stays."""
    sums = rows.mapInArrow(_sums(Lists.of(centers)), "cluster int, n long, total array<long>")
    sums = sums.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = centers.copy()
    for r in sums.select("cluster", "i", "x", "n").collect():      # k * dims rows
        out[r["cluster"], r["i"]] = r["x"] // r["n"]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = CLUSTERS, rounds: int = ROUNDS,
            dims: int = DIMS, scale: int = SCALE, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector, after `rounds` rounds and one more assignment.

    Null vectors, those of another length and those with a null, non-finite or too large component (LARGEST) are left out. Repeated rows are
    vectors of their own; a vector without identifier is clustered but starts no centroid. With fewer vectors than k there are fewer
    centroids, and without any (or without identifiers) no rows. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_col, vector_col, dims=dims, scale=scale), "orchard-vectors")
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    centers = starting(rows, k, seed)
    if not len(centers):
        return rows.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    with arrow_rows(spark, BATCH):
        for _ in range(rounds):
            new = moved(rows, centers)
            if (new == centers).all():                       # no later round moves anything
                break
            centers = new
        found = stored(rows.mapInArrow(_assigned(Lists.of(centers)), schema), "orchard-assigned")
    digests = [(i, hashlib.sha256(",".join(map(str, center.tolist())).encode()).hexdigest()) for i, center in enumerate(centers)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per_cluster = sums.join(F.broadcast(named), "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))      # k rows
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
