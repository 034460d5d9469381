"""Centroid clustering with a vantage-point tree over the centroids.

Vectors become exact integers, ``floor(scale * x)`` of every component. Each
round builds a vantage-point tree over the centroids (a number of rows that is
a parameter), sends it to every task, and finds each vector's nearest centroid
by best-first branch and bound: a node holds one centroid and, for each of its
two children, the range of its members' distances from it; by the triangle
inequality that range bounds a child's distance from the vector below. Children
leave the queue by their bounds, the smallest first, until the least bound is
beyond the best distance found. The radius is inclusive (a child whose bound
equals it is still visited, as it may hold an equally near centroid of a smaller
number), and distances that are compared are exact integers. Bounds are
floating-point numbers with a slack wider than their rounding.

Tasks send sums of their vectors' components in 32-bit limbs, a number of rows
that is the same for any table; Spark adds them up, and floored means come back
to the driver, one number for each centroid and component.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagloom.llm.common import settle

_ROWS = 4096
#: Components below this have differences and sums of 64 squares that fit in 64 bits.
_SMALL = 1 << 27
_LIMB = 32
_LONG = (1 << 63) - 1


class VantageTree:
    """``centre[i]`` is node ``i``'s centroid; ``below[i]`` lists (child, nearest, farthest)."""

    def __init__(self, centroids: list[list[int]]):
        self.points = centroids
        self.centre: list[int] = []
        self.below: list[list[tuple[int, float, float]]] = []
        small = all(-_SMALL < v < _SMALL for c in centroids for v in c)
        self.table = np.array(centroids, np.int64).reshape(len(centroids), -1) if small else None
        if centroids:
            self._grow(list(range(len(centroids))))

    def _grow(self, members: list[int]) -> None:
        """Splits by the median distance from the first member; equal centroids make it deeper."""
        pending = [(None, members)]
        while pending:
            parent, members = pending.pop()
            at = len(self.centre)
            if parent is not None:
                above, low, high = parent
                self.below[above].append((at, low, high))
            self.centre.append(members[0])
            self.below.append([])
            far = sorted((_root(self.squared(self.points[members[0]], m)), m) for m in members[1:])
            half = (len(far) + 1) // 2
            for part in (far[:half], far[half:]):
                if part:
                    pending.append(((at, part[0][0], part[-1][0]), [m for _, m in part]))

    def squared(self, x: list[int], number: int) -> int:
        return sum((a - b) * (a - b) for a, b in zip(x, self.points[number]))

    def nearest(self, x: list[int]) -> tuple[int, int]:
        """(centroid, squared distance) of one vector of integers of any size."""
        best, heap = (math.inf, -1), [(0.0, 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if not _within(bound, best[0]):
                break
            distance = self.squared(x, self.centre[node])
            best = min(best, (distance, self.centre[node]))
            d = _root(distance)
            for child, low, high in self.below[node]:
                heapq.heappush(heap, (_bound(d, low, high), child))
        return best[1], best[0]

    def nearest_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for rows of small integers, each with a queue of its own, a step of all at a time."""
        best = np.full(len(x), _LONG, np.int64)
        which = np.full(len(x), len(self.points), np.int64)
        queue = np.full((len(x), len(self.centre)), np.inf)
        queue[:, 0] = 0
        rows = np.arange(len(x))
        while len(rows):
            waiting = queue[rows]
            node = waiting.argmin(axis=1)
            bound = waiting[np.arange(len(rows)), node]
            go = np.isfinite(bound) & (bound * bound <= best[rows] * (1 + 1e-12))
            rows, node = rows[go], node[go]
            queue[rows, node] = np.inf
            order = np.argsort(node, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                if not len(part):
                    continue
                at, here = rows[part], int(node[part[0]])
                gap = x[at] - self.table[self.centre[here]]
                distance = np.einsum("ij,ij->i", gap, gap)
                better = (distance < best[at]) | ((distance == best[at]) & (self.centre[here] < which[at]))
                best[at[better]], which[at[better]] = distance[better], self.centre[here]
                d = np.sqrt(distance.astype(np.float64))
                for child, low, high in self.below[here]:
                    queue[at, child] = np.maximum(np.maximum(d - high, low - d) - 1e-9 * (d + high) - 1e-6, 0)
        return which, best


def _root(squared: int) -> float:
    try:
        return math.sqrt(squared)
    except OverflowError:
        return float(math.isqrt(squared)) if squared.bit_length() < 2040 else math.inf


def _bound(d: float, low: float, high: float) -> float:
    if math.isinf(d) or math.isinf(high):
        return 0.0  # past the range of doubles nothing is pruned
    return max(max(d - high, low - d) - 1e-9 * (d + high) - 1e-6, 0.0)


def _within(bound: float, best) -> bool:
    try:
        return bound * bound <= best * (1 + 1e-12)
    except OverflowError:
        return True


def _integers(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """``floor(scale * x)`` of rows of doubles; rows with a large component are lists of integers by row."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    large = ~(np.abs(scaled) < _SMALL).all(axis=1)
    exact = {int(i): [int(s) if math.isfinite(s) else int(x) * scale for s, x in zip(scaled[i].tolist(), vectors[i].tolist())]
             for i in np.flatnonzero(large)}
    scaled[large] = 0
    return scaled.astype(np.int64), exact


def _assigned(batch: pa.RecordBatch, tree: VantageTree, size: int, scale: int):
    """Slices of a batch: integers, large rows, centroid numbers and squared distances (large ones by row)."""
    for at in range(0, batch.num_rows, _ROWS):
        part = batch.slice(at, _ROWS)
        raw = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        x, exact = _integers(raw, scale)
        if tree.table is None:
            exact = {i: exact.get(i) or x[i].tolist() for i in range(len(x))}
            which, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        else:
            which, distance = tree.nearest_rows(x)
        far = {}
        for i, v in exact.items():
            which[i], far[i] = tree.nearest(v)
        yield part, x, exact, which, distance, far


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) whose sum is ``value``; only the last limb may be negative."""
    place = 0
    while not -(1 << _LIMB) < value < (1 << _LIMB):
        yield place, value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        place += 1
    yield place, value


def clean_vectors(table: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """``(vec_id, vec)``, as doubles, of the vectors of exactly ``size`` components, none null or non-finite."""
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.where((F.size("vec") == size) & F.forall(
        "vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def cluster(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64, k: int = 40,
            rounds: int = 5, scale: int = 256, salt: str = "2") -> DataFrame:
    """One row per vector kept: ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia`` and ``inertia`` (distance summed over its cluster and all),
    ``centroid_sha256`` (of its final centroid's components, joined by commas).

    Kept are vectors of exactly ``size`` (64 at most) finite components. The first
    centroids are the ``k`` vectors with the smallest SHA-256 of ``salt:id`` (all, if
    there are fewer; rows of one id in the order of their components); null ids
    start none but are assigned. ``rounds`` times every vector goes to the nearest
    centroid (ties: the smaller number) and every centroid with vectors becomes
    their floored mean. Repeated rows count as often as they occur. Assignment
    and means are exact for components of any size; a distance or sum past the
    64-bit range is null. Without a vector that has an id there are no rows.
    """
    if not 0 < size <= 64:
        raise ValueError("size must be from 1 to 64")
    spark = table.sparkSession
    vectors = settle(clean_vectors(table, id_col, vec_col, size), "vp-vectors")
    ident = vectors.schema["vec_id"].dataType.simpleString()
    by_hash = F.sha2(F.concat_ws(":", F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id IS NOT NULL").orderBy(by_hash, "vec").limit(k).select("vec").toArrow()
    if not first.num_rows:
        return spark.createDataFrame([], f"vec_id {ident}, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    start = first.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    x, exact = _integers(start, scale)
    centroids = [exact.get(i) or x[i].tolist() for i in range(len(x))]

    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        total: dict[tuple[int, int], int] = {}
        # at most one row for each centroid, component (count: -1) and limb
        for r in (vectors.mapInArrow(_sums(tree, size, scale), "c int, d int, limb int, s long")
                  .groupBy("c", "d", "limb").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()):
            key = r["c"], r["d"]
            total[key] = total.get(key, 0) + (int(r["s"]) << (_LIMB * r["limb"]))
        centroids = [[total[c, d] // total[c, -1] for d in range(size)] if (c, -1) in total else old
                     for c, old in enumerate(centroids)]
        tree.unpersist()

    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, which, distance, far in _assigned(batch, tree.value, size, scale):
                mask = np.zeros(len(which), bool)
                for i, d in far.items():
                    mask[i], distance[i] = d > _LONG, min(d, _LONG)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(distance, mask=mask)],
                    ["vec_id", "cluster", "distance"])

    labels = settle(vectors.mapInArrow(label, f"vec_id {ident}, cluster int, distance long"), "vp-labels")
    sums = {r["cluster"]: None if r["n"] != r["known"] else int(r["s"]) for r in labels.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"),
        F.count("distance").alias("known")).collect()}  # a row for each centroid
    every = sum(sums.values()) if None not in sums.values() else None
    fits = lambda v: v if v is not None and v <= _LONG else None
    facts = [(c, fits(s), fits(every), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
             for c, s in sorted(sums.items())]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (labels.join(F.broadcast(named), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def _sums(tree, size: int, scale: int):
    """A task's sums and counts by centroid, as limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tree.value.points)
        sums, counts, large = np.zeros((k, size), np.int64), np.zeros(k, np.int64), {}
        for batch in batches:
            for _, x, exact, which, _, _ in _assigned(batch, tree.value, size, scale):
                counts += np.bincount(which, minlength=k)
                x[list(exact)] = 0
                order = np.argsort(which, kind="stable")
                cuts = np.flatnonzero(np.diff(which[order], prepend=-1))
                sums[which[order][cuts]] += np.add.reduceat(x[order], cuts, axis=0)
                for i, v in exact.items():
                    have = large.get(int(which[i]), [0] * size)
                    large[int(which[i])] = [a + b for a, b in zip(have, v)]
        rows = []
        for c in np.flatnonzero(counts).tolist():
            more = large.get(c, [0] * size)
            rows.append((c, -1, 0, int(counts[c])))
            for d, s in enumerate(sums[c].tolist()):
                rows.extend((c, d, place, limb) for place, limb in _limbs(s + more[d]))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                ["c", "d", "limb", "s"])

    return run
