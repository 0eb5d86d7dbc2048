"""Centroid clustering with an annulus search, in exact integers.

A vector can only be nearer to a centroid than a bound u if the two norms differ by u at most. So the centroids are sorted by
norm; a vector's bound is its distance to the one whose norm is nearest to its own; a binary search gives the centroids whose
norms lie within the annulus of that bound, and only these are compared exactly, as squared distances of integers. The annulus
is widened by the rounding error of the norms, so a centroid at exactly the bound is always compared, and of equal distances the
smaller number is taken.

Vectors are written once and stay where they are. A round broadcasts the centroids and gives back each task's sums and counts by
centroid, so a round moves (tasks x centroids) rows, whatever share of the rows a cluster or a group of equal vectors has.

Cases: vectors that are null, of another length than `width`, or hold null or non-finite components take no part; a null id
belongs to a cluster and gives null, but is no start; rows that repeat an id are rows of their own, as starts too; with fewer
vectors than centroids there are as many centroids as vectors with an id; without any such vector the result is empty; empty
centroids stay where they are; sums beyond 64 bits are exact, distances and inertia beyond them count as the largest long.
Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, regrouped, tidy
from .integers import LARGEST, clipped, finite, largest, matrices, whole_components

#: Rows that one vectorised pass takes at once.
BLOCK_ROWS = 4096


def usable(rows: DataFrame, width: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    vector = F.col(vec_col).cast("array<double>")
    own = rows.where((F.size(vector) == width) & finite(vector))
    return materialize(own.select(F.col(id_col).cast("long").alias("vec_id"), whole_components(vector, scale).alias("v")))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """(centroids, width): the vectors whose ids have the smallest hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.most = largest(centroids)
        norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]

    def squared(self, x: np.ndarray, j: int | np.ndarray, most: float) -> np.ndarray:
        """Exact squared distances of the vectors to centroid j (or each to its own), as longs, or Python integers if these don't suffice."""
        if 4 * most * most * x.shape[1] < 1 << 62:
            apart = x - self.centroids[j]
            return np.einsum("ij,ij->i", apart, apart)
        apart = x.astype(object) - self.centroids[j].astype(object)
        return (apart * apart).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid of each vector and its exact squared distance."""
        k, most = len(self.order), max(self.most, largest(x))
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        right = np.minimum(np.searchsorted(self.norm, norm), k - 1)
        left = np.maximum(right - 1, 0)
        near = np.where(norm - self.norm[left] < self.norm[right] - norm, left, right)
        best = self.squared(x, self.order[near], most)
        number = self.order[near].copy()
        bound = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norm + bound + self.norm[-1] + 1)
        lo = np.searchsorted(self.norm, norm - bound - slack, "left")
        hi = np.searchsorted(self.norm, norm + bound + slack, "right")
        for place, j in enumerate(self.order):
            at = np.flatnonzero((lo <= place) & (place < hi) & (near != place))
            if len(at):
                own = self.squared(x[at], j, most)
                better = (own < best[at]) | ((own == best[at]) & (j < number[at]))
                best[at[better]], number[at[better]] = own[better], j
        return number, best


def sums(vectors: DataFrame, annulus: Annulus) -> dict[int, tuple[int, list[int]]]:
    """Count and exact componentwise sums of the vectors of each centroid that has any."""
    held = vectors.sparkSession.sparkContext.broadcast(annulus)

    def run(batches):
        total: dict[int, list] = {}
        for t in regrouped(batches, BLOCK_ROWS):
            for _, x in matrices(t.column("v")).values():
                number, _ = held.value.nearest(x)
                whole = x if largest(x) * len(x) < 1 << 62 else x.astype(object)
                for j in np.unique(number):
                    own = whole[number == j]
                    part = [int(s) for s in own.sum(0)]
                    n, before = total.get(int(j), (0, [0] * len(part)))
                    total[int(j)] = n + len(own), [a + b for a, b in zip(before, part, strict=True)]
        if total:
            amounts = pa.array([[Decimal(s) for s in part] for _, part in total.values()], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), amounts], ["cluster", "n", "amounts"])

    parts = vectors.select("v").mapInArrow(tidy(run), "cluster int, n long, amounts array<decimal(38,0)>")
    each = parts.select("cluster", "n", F.posexplode("amounts").alias("at", "amount")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in each.orderBy("cluster", "at").collect():  # one row for each component of a centroid
        out.setdefault(r.cluster, (r.n, []))[1].append(int(r.amount))
    return out


def cluster(rows: DataFrame, *, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after that many rounds; components count as floor(scale * x)."""
    vectors = usable(rows, width, scale, id_col, vec_col)
    schema = "vec_id long, cluster int, distance long"
    centroids = starts(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for j, (n, amounts) in sums(vectors, Annulus(centroids)).items():
            centroids[j] = [a // n for a in amounts]
    held = vectors.sparkSession.sparkContext.broadcast(Annulus(centroids))

    def run(batches):
        for t in regrouped(batches, BLOCK_ROWS):
            for at, x in matrices(t.column("v")).values():
                number, best = held.value.nearest(x)
                yield pa.RecordBatch.from_arrays([t.column("vec_id").combine_chunks().take(pa.array(at)), pa.array(number, pa.int32()), pa.array(clipped(best))], ["vec_id", "cluster", "distance"])

    placed = materialize(vectors.mapInArrow(tidy(run), schema))
    by = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    most = F.lit(LARGEST).cast("decimal(38,0)")
    each = {r.cluster: int(r.s) for r in by.collect()}  # one row for each centroid
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = vectors.sparkSession.createDataFrame([(j, Decimal(s), Decimal(sum(each.values())), names[j]) for j, s in each.items()], "cluster int, c decimal(38,0), t decimal(38,0), centroid_sha256 string")
    own = facts.select("cluster", F.least("c", most).cast("long").alias("cluster_inertia"), F.least("t", most).cast("long").alias("inertia"), "centroid_sha256")
    return placed.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
