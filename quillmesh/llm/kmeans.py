"""Centroid clustering with exact integers, by kd-tree filtering.

Each task packs its vectors into kd-trees of at most TREE_ROWS vectors, without a shuffle. A node
knows the count, the integer sum and the box of its vectors. The trees are written to the shared
folder once; every round reads them. On its way down a tree a centroid is dropped where it is
strictly dominated: the one nearest to the box's middle is nearer to every point of the box. Where
one centroid is left, the node's count and sum go to it as a whole; leaves with more left are
resolved vector by vector. All comparisons are of integers, so no rounding decides and ties go to
the smaller number. What leaves the tasks in a round is a sum for each centroid and dimension.

The first centroids are the k vectors with the least SHA-256 of "<salt>:<vec_id>"; rows of equal id
are ordered by their components, those with a null id come last, so they are taken only where
others are too few. Vectors of another length, with null or non-finite components, and null
vectors are left out. Repeated rows all count and all come back. Fewer than k vectors make as many
centroids. An empty table gives no rows. Extra columns are not looked at. Components beyond 2^52
raise an error; a distance or a sum of distances that no long can hold is null.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import bounded_batches, column, written
from quillmesh.llm.embeddings import SCALE, vectors

#: Vectors of one tree, and of one leaf at most.
TREE_ROWS = 1 << 15
LEAF = 24
#: Numbers of an intermediate array.
AT_ONCE = 1 << 21
_LONG = (1 << 63) - 1


class Tree:
    """A balanced kd-tree: level l has 2^l nodes, each a range of the points in their order."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, named: np.ndarray, edges: list[np.ndarray] | None = None):
        self.points, self.ids, self.named = points, ids, named
        depth = 0
        while len(points) >> depth > LEAF:
            depth += 1
        leaves = (np.arange((1 << depth) + 1) * len(points)) >> depth
        self.edges = [leaves[:: 1 << (depth - level)] for level in range(depth + 1)]

    def ordered(self) -> Tree:
        """Splits each node at its middle along its box's longest side."""
        order = np.arange(len(self.points))
        for here, below in zip(self.edges, self.edges[1:], strict=False):
            for i, (a, b) in enumerate(zip(here[:-1].tolist(), here[1:].tolist(), strict=True)):
                rows = order[a:b]
                held = self.points[rows]
                side = int(np.argmax(held.max(0) - held.min(0)))
                order[a:b] = rows[np.argpartition(held[:, side], int(below[2 * i + 1]) - a)]
        self.points, self.ids, self.named = self.points[order], self.ids[order], self.named[order]
        return self

    def summed(self) -> Tree:
        """Boxes and sums of all nodes, from the leaves up."""
        starts = self.edges[-1][:-1]
        low, high, total = ([f.reduceat(self.points, starts, axis=0)] for f in (np.minimum, np.maximum, np.add))
        for _ in self.edges[1:]:
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
            total.append(total[-1][::2] + total[-1][1::2])
        self.low, self.high, self.total = low[::-1], high[::-1], total[::-1]
        return self

    def packed(self) -> bytes:
        """The points in the smallest integers that hold them, and all nodes."""
        least = next(t for t in (np.int16, np.int32, np.int64) if not len(self.points) or np.iinfo(t).min <= self.points.min() and self.points.max() <= np.iinfo(t).max)
        out = io.BytesIO()
        nodes = {f"{k}{i}": x for k, xs in (("low", self.low), ("high", self.high), ("total", self.total)) for i, x in enumerate(xs)}
        np.savez(out, points=self.points.astype(least), ids=self.ids, named=self.named, **{k: x.astype(least) if k[0] != "t" else x for k, x in nodes.items()})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        held = np.load(io.BytesIO(data))
        tree = cls(held["points"], held["ids"], held["named"])
        tree.low, tree.high, tree.total = ([held[f"{k}{i}"] for i in range(len(tree.edges))] for k in ("low", "high", "total"))
        return tree


def numbers(held: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The arrays in 64 bits where no squared distance among them can leave those, else as whole numbers of any size."""
    top = max((max(abs(int(x.max())), abs(int(x.min()))) for x in (held, *others) if x.size), default=0)
    kind = np.int64 if 16 * held.shape[-1] * top * top <= _LONG else object
    return [x.astype(kind) for x in (held, *others)]


def _nearest(scores: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The first of the least scores among those alive."""
    return np.argmin(np.where(alive, scores, scores.max() + 1), axis=1)


def settled(tree: Tree, centroids: np.ndarray):
    """(level, nodes, clusters) of nodes that have one centroid as a whole, and (None, points, clusters) of single points."""
    k = len(centroids)
    step = max(1, AT_ONCE // centroids.size)
    nodes, alive = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level in range(len(tree.edges)):
        best = np.zeros(len(nodes), np.int64)
        for at in range(0, len(nodes), step):
            some = slice(at, at + step)
            low, high, c = numbers(tree.low[level][nodes[some]], tree.high[level][nodes[some]], centroids)
            norms = (c * c).sum(1)
            best[some] = b = _nearest(norms - (low + high) @ c.T, alive[some])
            # |z - p|^2 - |best - p|^2 is linear in p: its least value over the box is at the corner towards z.
            towards = c[None] - c[b][:, None]
            least = norms[None] - norms[b][:, None] - 2 * np.where(towards > 0, towards * high[:, None], towards * low[:, None]).sum(2)
            alive[some] &= (least <= 0).astype(bool)
        whole = alive.sum(1) == 1
        if whole.any():
            yield level, nodes[whole], best[whole]
        nodes, alive = nodes[~whole], alive[~whole]
        if level + 1 < len(tree.edges):
            nodes, alive = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(alive, 2, axis=0)
    sizes = np.diff(tree.edges[-1])[nodes]
    points = np.repeat(tree.edges[-1][nodes] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    alive = np.repeat(alive, sizes, axis=0)
    for at in range(0, len(points), step):
        some = points[at : at + step]
        p, c = numbers(tree.points[some], centroids)
        yield None, some, _nearest((c * c).sum(1) - 2 * (p @ c.T), alive[at : at + step])


def round_sums(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the vectors nearest to each centroid."""
    k = len(centroids)
    counts, sums = np.zeros(k, object), np.zeros(centroids.shape, object)
    for level, which, cluster in settled(tree, centroids):
        sizes, held = (np.diff(tree.edges[level])[which], tree.total[level][which]) if level is not None else (np.ones(len(which), np.int64), tree.points[which].astype(np.int64))
        for j in np.unique(cluster).tolist():
            counts[j] += int(sizes[cluster == j].sum())
            sums[j] += held[cluster == j].astype(object).sum(0) if np.abs(held).max() > 1 << 40 else held[cluster == j].sum(0).astype(object)
    return counts, sums


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each point."""
    cluster = np.zeros(len(tree.points), np.int32)
    for level, which, of in settled(tree, centroids):
        if level is None:
            cluster[which] = of
        else:
            starts, ends = tree.edges[level][which], tree.edges[level][which + 1]
            for a, b, j in zip(starts.tolist(), ends.tolist(), of.tolist(), strict=True):
                cluster[a:b] = j
    p, c = numbers(tree.points, centroids)
    return cluster, ((p - c[cluster]) ** 2).sum(1)


def build_trees(rows: DataFrame, dims: int) -> DataFrame:
    """(tree binary) of (vec_id, v); each task makes its own."""

    def run(batches):
        held, ids, named, n = [], [], [], 0

        def tree():
            return pa.RecordBatch.from_pydict({"tree": [Tree(np.concatenate(held), np.concatenate(ids), np.concatenate(named)).ordered().summed().packed()]}, schema)

        for batch in batches:
            raw = column(batch, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            points = np.floor(SCALE * raw)
            if points.size and np.abs(points).max() >= 2.0**62:
                raise ValueError("a component is beyond 2^52")
            points, which = points.astype(np.int64), column(batch, "vec_id")
            for at in range(0, len(points), TREE_ROWS):
                held.append(points[at : at + TREE_ROWS])
                ids.append(which.fill_null(0).to_numpy(zero_copy_only=False)[at : at + TREE_ROWS])
                named.append(which.is_valid().to_numpy(zero_copy_only=False)[at : at + TREE_ROWS])
                n += len(held[-1])
                if n >= TREE_ROWS:
                    yield tree()
                    held, ids, named, n = [], [], [], 0
        if n:
            yield tree()

    schema = pa.schema([("tree", pa.binary())])
    return rows.mapInArrow(run, "tree binary")


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    scaled = F.transform("v", lambda x: F.floor(x * SCALE))
    told = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(told.alias("h"), scaled.alias("q")).orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in found], np.int64)


def next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; a cluster without vectors stays where it is. k * (dims + 1) sums come to the driver."""
    k, dims = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, object), np.zeros((k, dims), object)
        for batch in batches:
            for data in column(batch, "tree"):
                n, s = round_sums(Tree.unpacked(data.as_py()), centroids)
                counts, sums = counts + n, sums + s
        told = np.concatenate([counts[:, None], sums], axis=1)
        yield pa.RecordBatch.from_pydict({"cluster": np.repeat(np.arange(k, dtype=np.int32), dims + 1), "place": np.tile(np.arange(dims + 1, dtype=np.int32), k), "s": [str(x) for x in told.ravel()]})

    told = trees.mapInArrow(run, "cluster int, place int, s string").groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = np.zeros((k, dims + 1), object)
    for r in told.collect():
        out[r["cluster"], r["place"]] = int(r["s"])
    return np.array([[int(x) // int(row[0]) for x in row[1:]] if row[0] else old.tolist() for row, old in zip(out, centroids, strict=True)], np.int64)


def clusters(table: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, salt: str = "3", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    spark = table.sparkSession
    rows = vectors(bounded_batches(table), vec_id, vector, dims)
    trees = written(build_trees(rows, dims))
    centroids = first_centroids(rows, k, salt)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], columns)
    for _ in range(rounds):
        centroids = next_centroids(trees, centroids)

    def run(batches):
        for batch in batches:
            for data in column(batch, "tree"):
                tree = Tree.unpacked(data.as_py())
                cluster, distance = assigned(tree, centroids)
                far = np.array(distance > _LONG, bool)
                told = pa.array(np.where(far, 0, distance).astype(np.int64), mask=far)
                yield pa.RecordBatch.from_arrays([pa.array(tree.ids, mask=~tree.named), pa.array(cluster), told], schema=schema)

    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
    found = written(trees.mapInArrow(run, "vec_id long, cluster int, distance long"))
    each = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect() if r["s"] is not None}
    long = lambda x: int(x) if x <= _LONG else None
    total = long(sum(each.values()))
    told = [(j, long(each.get(j, 0)), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
