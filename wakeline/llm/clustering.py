"""Lloyd rounds over integer vectors, searched through a vantage-point tree of the centroids.

Each round builds the tree on the driver from the k centroids (k and the vector size
are parameters, so tree and broadcast have a fixed size) and hands it to all tasks. A
task searches for a batch of vectors at once: every vector visits, of the nodes it has
not seen, the one with the least lower bound, as long as that bound is not above its best
distance. The bound is inclusive, so equal distances are found and the smaller number
wins; distances at nodes and leaves are exact integers, and bounds, which come from
square roots, are lowered by more than their rounding error. A task adds up its vectors
by cluster and sends k sums; a vector itself is never shuffled.

Cases: vectors that are null, have another size or any null or non-finite component are
left out; equal vectors and repeated rows count each; a null identifier takes part and
its hash is that of the word null; components beyond 2^18 count as 2^18 (2^26 scaled);
with fewer vectors than k each one starts a centroid; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wakeline.llm.common import durable
from wakeline.llm.vectors import matrix, vector_rows

SIZE, CLUSTERS, ROUNDS = 64, 40, 5
LEAF = 3  # centroids of a leaf
SLACK = 1e-9  # share of a sum of distances by which a bound is lowered
BATCH = 4096


@dataclass
class Node:
    items: list[int]  # centroids whose distance is taken here: one vantage point, or a leaf's
    children: list[tuple[int, float, float]]  # node, least and largest distance of its centroids to the vantage point


class VantageTree:
    """Centroids by distance to vantage points; the nearer half of the rest is one child, the others the second."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.nodes: list[Node] = []
        self._grow(list(range(len(centroids))))

    def _grow(self, members: list[int]) -> int:
        at = len(self.nodes)
        node = Node(members, [])
        self.nodes.append(node)
        if len(members) > LEAF:
            vantage, rest = members[0], np.array(members[1:])
            node.items = [vantage]
            squared = ((self.centroids[rest] - self.centroids[vantage]) ** 2).sum(1)
            order = np.argsort(squared, kind="stable")
            for half in np.array_split(order, 2):
                far = np.sqrt(squared[half].astype(np.float64))
                node.children.append((self._grow(sorted(rest[half].tolist())), float(far.min()), float(far.max())))
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row and the squared distance."""
        n = len(vectors)
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        radius = np.full(n, np.inf)
        active = np.arange(n)
        while len(active):
            node = bound[active].argmin(1)
            least = bound[active, node]
            open_ = np.isfinite(least) & (least <= radius[active])
            active, node, least = active[open_], node[open_], least[open_]
            for at in np.unique(node):
                self._visit(at, active[node == at], vectors, bound, least[node == at], best, who)
            radius[active] = np.sqrt(best[active].astype(np.float64)) * (1 + SLACK)
        return who, best

    def _visit(self, at, rows, vectors, bound, least, best, who) -> None:
        node = self.nodes[at]
        bound[rows, at] = np.inf
        for item in node.items:
            squared = ((vectors[rows] - self.centroids[item]) ** 2).sum(1)
            better = (squared < best[rows]) | ((squared == best[rows]) & (item < who[rows]))
            best[rows[better]], who[rows[better]] = squared[better], item
        if node.children:  # the one item is the vantage point
            away = np.sqrt(squared.astype(np.float64))
            for child, low, high in node.children:
                gap = np.maximum(away - high, low - away) - SLACK * (away + high + 1)
                bound[rows, child] = np.maximum(least, gap)


def _sums(shared, size: int):
    def run(batches):
        tree = shared.value
        k = len(tree.centroids)
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                vectors = matrix(batch.column("v").slice(start, BATCH), size)
                who, _ = tree.nearest(vectors)
                n += np.bincount(who, minlength=k)
                np.add.at(total, who, vectors)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(used, size).astype(np.int32)),
            "place": pa.array(np.tile(np.arange(size), len(used)).astype(np.int32)),
            "total": pa.array(total[used].ravel()), "n": pa.array(np.repeat(n[used], size)),
        })

    return run


def _assign(shared, size: int):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                who, squared = shared.value.nearest(matrix(part.column("v"), size))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(who.astype(np.int32)), pa.array(squared)], ["vec_id", "cluster", "distance"]
                )

    return run


def first_centroids(kept: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose identifiers hash lowest; equal hashes by the vector."""
    name = F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = kept.select(F.sha2(F.encode(name, "UTF-8"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Floor of the mean of each cluster's vectors, from exact sums; empty ones stay."""
    out = centroids.copy()
    whole = sums.groupBy("cluster", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
    )
    for row in whole.collect():  # at most k times the vector size rows
        out[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(
    table: DataFrame, vector: str = "embedding", key: str = "vec_id", size: int = SIZE, k: int = CLUSTERS, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every whole vector, and the final centroids."""
    context = table.sparkSession.sparkContext
    kept = durable(vector_rows(table, vector, F.size(vector) == size, F.col(key).cast("bigint").alias("vec_id")))
    centroids = first_centroids(kept, k)
    if not len(centroids):
        return table.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    for _ in range(rounds):
        tree = context.broadcast(VantageTree(centroids))
        centroids = moved(centroids, kept.select("v").mapInArrow(_sums(tree, size), "cluster int, place int, total bigint, n bigint"))
        tree.unpersist()
    tree = context.broadcast(VantageTree(centroids))
    return durable(kept.mapInArrow(_assign(tree, size), "vec_id bigint, cluster int, distance bigint")), centroids


def cluster_report(table: DataFrame, **options) -> DataFrame:
    """clusters() with the inertia of each cluster and of all, and the digest of the final centroid."""
    assigned, centroids = clusters(table, **options)
    per = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k rows
    inertia = sum(int(r["s"]) for r in per)
    rows = [(r["cluster"], int(r["s"]), inertia, digest(centroids[r["cluster"]])) for r in per]
    found = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(found), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
