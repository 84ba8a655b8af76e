"""Centroid clustering of integer vectors: a vantage-point tree over the centroids, rebuilt and broadcast each round.

Every vector searches the tree best-first with branch and bound; distances of centroids are exact integers and ties go to
the smaller number.  Vectors stay where they are: a task sends one sum per centroid.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.tables import written

# Vectors that are searched together; bounds the table of node bounds beside them.
PIECE = 2_048
LEAF = 2
_SLACK = 1e-14  # of both lengths; far above the rounding of square roots, so nothing that could win is pruned
_FAR = np.iinfo(np.int64).max


def largest(dims: int) -> int:
    """Components below this in size have squared distances that fit 64 bits."""
    return int((2**62 / dims) ** 0.5) // 2


def squares(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to a point."""
    apart = vectors - point
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class Node:
    points: list[int]  # whose distances are taken here; the first is the vantage point
    inside: int = -1  # child nodes: at most and at least the median distance from the vantage point
    outside: int = -1
    # least and largest distance from the vantage point to points of each child
    near: tuple[float, float] = (0.0, 0.0)
    far: tuple[float, float] = (0.0, 0.0)


class VantageTree:
    """Nearest of a set of integer points; of equally near ones the smallest number."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.leaf = points.astype(np.int64), leaf
        self.nodes: list[Node] = []
        if len(points):
            self._grow(list(range(len(points))))

    def _grow(self, of: list[int]) -> int:
        name = len(self.nodes)
        if len(of) <= self.leaf:
            self.nodes.append(Node(of))
            return name
        # the point farthest from the middle of the set splits it best
        middle = self.points[of].sum(0) // len(of)
        vantage = of[int(np.argmax(squares(self.points[of], middle)))]
        rest = np.array([i for i in of if i != vantage])
        away = squares(self.points[rest], self.points[vantage])
        order = np.argsort(away, kind="stable")
        half = (len(rest) + 1) // 2
        node = Node([vantage])
        self.nodes.append(node)
        reach = np.sqrt(away[order].astype(np.float64))
        node.near = (float(reach[0]), float(reach[half - 1]))
        node.inside = self._grow(rest[order[:half]].tolist())
        if half < len(rest):
            node.far = (float(reach[half]), float(reach[-1]))
            node.outside = self._grow(rest[order[half:]].tolist())
        return name

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest point of each vector.

        Every vector has its own queue of nodes by the least distance that points below them can have, and always opens
        the first; it stops when that bound lies beyond its best distance.  Vectors that open the same node are taken together.
        """
        n = len(vectors)
        best, which = np.full(n, _FAR, np.int64), np.full(n, len(self.points), np.int64)
        queue = np.full((n, len(self.nodes)), np.inf)
        queue[:, :1] = 0.0
        active = np.arange(n) if self.nodes else np.arange(0)
        while len(active):
            opened = queue[active].argmin(1)
            low = queue[active, opened]
            # inclusive: a point at just the best distance may have a smaller number
            going = low * low * (1 - 1e-12) <= best[active].astype(np.float64)
            going &= np.isfinite(low)
            active, opened = active[going], opened[going]
            for name in np.unique(opened).tolist():
                node, rows = self.nodes[name], active[opened == name]
                bound = queue[rows, name]
                queue[rows, name] = np.inf
                for j, point in enumerate(node.points):
                    d = squares(vectors[rows], self.points[point])
                    wins = (d < best[rows]) | ((d == best[rows]) & (point < which[rows]))
                    best[rows[wins]], which[rows[wins]] = d[wins], point
                    if j == 0 and node.inside >= 0:
                        away = np.sqrt(d.astype(np.float64))
                        for child, (least, most) in ((node.inside, node.near), (node.outside, node.far)):
                            if child >= 0:
                                slack = (away + most) * _SLACK
                                queue[rows, child] = np.maximum(bound, np.maximum(away - most, least - away) - slack)
        return which, best


def integer_vectors(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, point): floor(scale * x) of all vectors of exactly ``dims`` components, none null or not finite."""
    held = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    limit = largest(dims)

    def floors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sized = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(v), dims), False))
            if not sized.num_rows:
                continue
            flat = sized.column("v").flatten().cast(pa.float64())
            values = flat.fill_null(float("nan")).to_numpy().reshape(-1, dims)
            good = np.isfinite(values).all(1)
            whole = np.floor(scale * values[good])
            if np.abs(whole).max(initial=0) >= limit:
                raise ValueError(f"components of {limit / scale:.3g} or more have no exact 64-bit distances")
            at = pa.array(np.arange(len(whole) + 1, dtype=np.int32) * dims)
            points = pa.ListArray.from_arrays(at, pa.array(whole.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([sized.column("id").filter(pa.array(good)), points], ["id", "point"])

    return held.mapInArrow(floors, T.StructType([held.schema["id"], T.StructField("point", T.ArrayType(T.IntegerType()))]))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in that order; of equal ids the smaller vector first."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = points.select(name.alias("name"), "point").orderBy("name", "point").limit(k).collect()
    return np.array([r["point"] for r in rows], np.int64)


def shared_tree(points: DataFrame, centroids: np.ndarray) -> Broadcast:
    """The tree as bytes, with its code: workers need no copy of this package.  Its size goes with the centroids alone."""
    return points.sparkSession.sparkContext.broadcast(cloudpickle.dumps(VantageTree(centroids)))


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the means of the vectors nearest to each centroid; a centroid without vectors stays."""
    k, dims = centroids.shape
    shared = shared_tree(points, centroids)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, total, n = pickle.loads(shared.value), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE):
                vectors = matrix(batch.column("point").slice(a, PIECE), dims)
                which, _ = tree.nearest(vectors)
                order = np.argsort(which, kind="stable")
                names, first = np.unique(which[order], return_index=True)
                total[names] += np.add.reduceat(vectors[order], first)
                n += np.bincount(which, minlength=k)
        held = np.flatnonzero(n)
        at = pa.array(np.arange(len(held) + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(n[held]), pa.ListArray.from_arrays(at, pa.array(total[held].ravel()))], ["cluster", "n", "total"]
        )

    out = centroids.copy()
    parts = points.select("point").mapInArrow(sums, "cluster long, n long, total array<long>")
    sums_of = parts.select("cluster", "n", F.posexplode("total").alias("i", "s")).groupBy("cluster", "i")
    for row in sums_of.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():
        out[row["cluster"], row["i"]] = int(row["s"]) // row["n"]  # one row per centroid and component
    shared.unpersist()
    return out


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance): the nearest centroid of every vector and the squared distance."""
    shared, dims = shared_tree(points, centroids), centroids.shape[1]

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE):
                part = batch.slice(a, PIECE)
                which, best = tree.nearest(matrix(part.column("point"), dims))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(which.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    fields = [points.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    return points.mapInArrow(near, T.StructType(fields))


def clustered(df: DataFrame, k: int, rounds: int, seed: int, dims: int, scale: int, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector, written, and the centroids after ``rounds`` rounds.

    Vectors of another size, null vectors and vectors with null or not finite components are left out.  There are fewer
    than ``k`` centroids if there are fewer vectors, none for an empty table.  Repeated rows count each; a null id hashes
    as an empty one.  Components too large for exact 64-bit distances (see :func:`largest`) are an error.  Other columns
    are ignored.
    """
    points = written(integer_vectors(df, key, vector, dims, scale), "points")
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    for _ in range(rounds):
        centroids = moved(points, centroids)
    return written(assigned(points, centroids), "assigned"), centroids


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
