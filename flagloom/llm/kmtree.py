"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then indexed under the
leaf it descends to. Leaves that hold too many rows are split again, each from a
bounded sample of its own in a task of its own, until none does (copies of one
vector cannot be split; the tree's size has a bound of its own). A query walks the tree best bin first: a priority queue
holds nodes by the distance to their centre, inner nodes put their children
back, leaves are visited in the order they come out. How many leaves a query
visits is calibrated: exact neighbours of some calibration queries are found by
brute force over the whole index, and the number of visits is widened until
they cover the wanted share. A query whose leaves do not hold enough rows goes
on to further leaves until they do.

The tree and all rough distances work on vectors scaled by a power of two (that
of the table's largest component, or of a block's), so squares of the largest and
smallest doubles neither overflow nor vanish; answers are ranked by the distance
of the vectors themselves.

Vectors and queries meet by leaf, in blocks of bounded size on either side, so
a leaf that holds a third of all rows is many tasks. Each block gives a
query's nearest few; a rank over those gives the answer.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flagloom.llm.common import settle

_ROWS, _QUERIES = 8192, 1024


@dataclass(frozen=True)
class Tree:
    """Node 0 is the root; ``children[i]`` is empty for a leaf, ``leaf[i]`` its number or -1.
    Centres, and the rows that meet them, are scaled by ``2 ** -exponent``."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    exponent: int = 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.ldexp(x, -self.exponent)

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))
        centres = sums[count > 0] / count[count > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _exponent(*parts: np.ndarray) -> int:
    """The power of two just above the largest component."""
    return int(np.frexp(max(np.abs(x).max(initial=0.0) for x in parts))[1])


def fit_tree(sample: np.ndarray, branch: int = 16, leaf_rows: int = 200, seed: int = 11,
             exponent: int | None = None, once: bool = False) -> Tree:
    """Split by k-means until a node holds at most ``leaf_rows`` sample rows or one distinct
    vector, or (with ``once``) the root alone, however few its rows."""
    exponent = _exponent(sample) if exponent is None else exponent
    sample = np.ldexp(sample, -exponent)
    rng = np.random.default_rng(seed)
    centres, children, leaf, queue = [sample.mean(axis=0)], [np.zeros(0, np.int64)], [-1], [(0, np.arange(len(sample)))]
    for node, rows in queue:
        wanted = node == 0 if once else len(rows) > leaf_rows
        parts = _kmeans(sample[rows], branch, rng) if wanted else np.zeros((0, 0))
        if len(parts) < 2:
            leaf[node] = max(leaf) + 1
            continue
        near = _nearest(sample[rows], parts)
        first = len(centres)
        children[node] = np.arange(first, first + len(parts))
        for j, c in enumerate(parts):
            centres.append(c)
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
            queue.append((first + j, rows[near == j]))
    return Tree(np.array(centres), children, np.array(leaf), exponent)


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of every row."""
    x = tree.scaled(x)
    at, moving = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(moving):
        order = moving[np.argsort(at[moving], kind="stable")]
        nodes, begin = np.unique(at[order], return_index=True)
        still = []
        for node, rows in zip(nodes, np.split(order, begin[1:])):
            kids = tree.children[node]
            if len(kids):
                at[rows] = kids[_nearest(x[rows], tree.centres[kids])]
                still.append(rows)
        moving = np.concatenate(still) if still else np.zeros(0, np.int64)
    return tree.leaf[at]


def bins(tree: Tree, q: np.ndarray) -> Iterator[int]:
    """Leaves as they come out of the priority queue."""
    q = tree.scaled(q)
    heap = [(0.0, 0)]
    while heap:
        _, node = heapq.heappop(heap)
        kids = tree.children[node]
        if not len(kids):
            yield int(tree.leaf[node])
            continue
        gap = tree.centres[kids] - q
        for d, kid in zip((gap * gap).sum(axis=1).tolist(), kids.tolist()):
            heapq.heappush(heap, (d, kid))


def best_bins(tree: Tree, q: np.ndarray, visits: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
    """The first ``visits`` leaves out of the priority queue, and as many more as
    it takes until they hold ``least`` of the ``rows`` (a count for each leaf)."""
    out, held = [], 0
    for leaf in bins(tree, q):
        out.append(leaf)
        held += int(rows[leaf]) if rows is not None else 0
        if len(out) >= visits and held >= least:
            break
    return out


def graft(tree: Tree, parts: dict[int, Tree]) -> Tree:
    """``tree`` with leaves replaced by trees of their own; their leaves get new numbers."""
    centres, children, leaf = [tree.centres], list(tree.children), [tree.leaf.copy()]
    node_of = {int(n): i for i, n in enumerate(tree.leaf) if n >= 0}
    nodes, leaves = len(tree.centres), tree.leaves
    for number, part in sorted(parts.items()):
        at = node_of[number]  # takes the place of the part's root
        children[at] = part.children[0] + nodes - 1
        leaf[0][at] = -1
        children.extend(kids + nodes - 1 if len(kids) else kids for kids in part.children[1:])
        centres.append(part.centres[1:])
        leaf.append(np.where(part.leaf[1:] >= 0, part.leaf[1:] + leaves, -1))
        nodes, leaves = nodes + len(part.centres) - 1, leaves + part.leaves
    return Tree(np.concatenate(centres), children, np.concatenate(leaf), tree.exponent)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; where squares would leave the range of doubles, of the
    difference scaled by a power of two (infinite only if the distance itself is past the range)."""
    with np.errstate(over="ignore", under="ignore"):
        gap = x - q
        exact = np.sqrt((gap * gap).sum(axis=1))
        most = np.abs(gap).max(axis=1, initial=0.0)
        for odd, by in ((most >= 1e140, 1), ((most > 0) & (most <= 1e-140), 0)):
            odd = np.flatnonzero(odd)
            if len(odd):  # halves of large ones cannot overflow
                part = np.ldexp(x[odd], -1) - np.ldexp(q, -1) if by else gap[odd]
                power = np.frexp(np.abs(part).max(axis=1))[1]
                part = np.ldexp(part, -power[:, None])
                exact[odd] = np.ldexp(np.sqrt((part * part).sum(axis=1)), power + by)
    return exact


def nearest_rows(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """The ``k`` nearest rows of ``x`` for each query, its own id left out, ties
    to smaller ids: (query place, row place, distance). Products sort out the
    far rows; the distance of those left is taken on the difference itself."""
    power = -_exponent(x, q)
    low, norms, out = np.ldexp(x, power), None, []
    norms = (low * low).sum(axis=1)
    for a in range(0, len(q), 64):
        part = np.ldexp(q[a:a + 64], power)
        rough = norms + (part * part).sum(axis=1)[:, None] - 2 * (part @ low.T)
        other = q_ids[a:a + 64, None] != x_ids
        rough[~other] = np.inf
        if x.shape[0] > k:
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
            bound = np.where(np.isfinite(bound), bound + 1e-9 * (np.abs(bound) + norms.max() + (part * part).sum(axis=1)), np.inf)
        else:
            bound = np.full(len(part), np.inf)
        for i in range(len(part)):
            near = np.flatnonzero((rough[i] <= bound[i]) & other[i])
            exact = distances(x[near], q[a + i])
            pick = np.lexsort((x_ids[near], exact))[:k]
            out.append((np.full(len(pick), a + i), near[pick], exact[pick]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def clean_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, vec)`` as doubles without what takes no part: null ids; null,
    zero, or not wholly finite vectors; vectors that are not of the commonest
    length (ties: the shorter). Rows of one id count once, with the least vector."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
                      & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                      & F.exists("vec", lambda v: v != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vec") == (size["n"] if size else 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def search(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10,
           sample_rows: int = 20000, calibration: int = 128, recall: float = 0.97, branch: int = 16,
           leaf_rows: int = 200, most_rows: int = 8192, most_leaves: int = 1 << 17) -> DataFrame:
    """The ``k`` nearest rows found for every row whose id is divisible by ``every``.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean
    distance in double precision). ``sample_rows`` bounds the tree's fit,
    ``calibration`` the queries of the brute-force measurement. Leaves of more than
    ``most_rows`` rows are split until there are ``most_leaves`` leaves, which bounds
    the tree that every task holds. What takes no
    part is listed at :func:`clean_vectors`; no vectors or no queries give no
    rows; a query with fewer than ``k`` candidates gets all of them.
    """
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = settle(clean_vectors(table, id_col, vec_col), "ann-vectors")
    by_hash = F.xxhash64("vec_id")
    largest = vectors.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
    sample = vectors.orderBy(by_hash, "vec_id").limit(sample_rows).select("vec").toArrow()
    if not sample.num_rows:
        return empty
    tree = fit_tree(_matrix(sample.column(0).combine_chunks()), branch, leaf_rows, exponent=int(np.frexp(largest)[1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = descend(tree, _matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *batch.columns],
                                                 ["leaf", "vec_id", "vec"])

    schema = "leaf int, vec_id long, vec array<double>"
    index = settle(vectors.mapInArrow(place, schema), "ann-index")
    whole: set[int] = set()  # leaves that cannot be split
    while True:
        # one row per leaf, whose number is bounded
        sizes = settle(index.groupBy("leaf").agg(F.count("*").alias("n")), "ann-sizes")
        held = np.zeros(tree.leaves, np.int64)
        for r in sizes.collect():
            held[r["leaf"]] = r["n"]
        large = [int(x) for x in np.argsort(-held) if held[x] > most_rows and x not in whole]
        parts = _split(index, sizes, large, branch, tree.exponent, most_leaves - tree.leaves)
        if not parts:
            break
        whole |= {x for x in large if x not in parts or parts[x].leaves == 1}
        parts = {x: p for x, p in parts.items() if p.leaves > 1}
        if not parts:
            break
        tree = graft(tree, parts)
        index = settle(index.select("vec_id", "vec").mapInArrow(place, schema), "ann-index")
    queries = index.where(F.col("vec_id") % every == 0)
    visits = _calibrate(tree, index, queries.orderBy(by_hash, "vec_id").limit(calibration), k, recall)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [best_bins(tree, q, visits, held, k + 1) for q in _matrix(part.column("vec"))]
                take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).astype(np.int32)), part.column("vec_id").take(take),
                     part.column("vec").take(take)], ["leaf", "query_id", "qvec"])

    visiting = queries.select("vec_id", "vec").mapInArrow(visited, "leaf int, query_id long, qvec array<double>")
    # one row per leaf: as many blocks as its rows and its queries need
    asked = visiting.groupBy("leaf").agg(F.count("*").alias("m"))
    blocks = F.broadcast(settle(
        sizes.join(asked, "leaf").select("leaf", F.ceil(F.col("n") / _ROWS).cast("int").alias("row_blocks"),
                                         F.ceil(F.col("m") / _QUERIES).cast("int").alias("query_blocks")), "ann-leaves"))

    def spread(df: DataFrame, own: str, own_id: str, other: str, names: tuple[str, str]) -> DataFrame:
        return (df.join(blocks, "leaf")
                .withColumn(names[0], F.pmod(F.xxhash64(own_id), F.col(own)).cast("int"))
                .withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .drop("row_blocks", "query_blocks"))

    rows = spread(index, "row_blocks", "vec_id", "query_blocks", ("b", "c"))
    asks = spread(visiting, "query_blocks", "query_id", "row_blocks", ("c", "b"))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                             "score": pa.array([], pa.float64())})
        x, q = (_matrix(t.column(c).combine_chunks()) for t, c in ((left, "vec"), (right, "qvec")))
        x_ids, q_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        i, j, score = nearest_rows(q, q_ids, x, x_ids, k)
        return pa.table({"query_id": q_ids[i], "vec_id": x_ids[j], "score": score})

    met = (rows.groupBy("leaf", "b", "c").cogroup(asks.groupBy("leaf", "b", "c"))
           .applyInArrow(meet, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _split(index: DataFrame, sizes: DataFrame, large: list[int], branch: int, exponent: int, room: int,
           sample_rows: int = 4000) -> dict[int, Tree]:
    """A tree of one level for each of the ``large`` leaves, the largest first and as many
    as there is ``room`` for, fitted in a task of its own on about ``sample_rows`` of its rows."""
    large = large[:max(0, room) // branch]
    if not large:
        return {}
    named = F.broadcast(sizes.where(F.col("leaf").isin(large)))  # a row for each of a bounded number of leaves
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < F.lit(sample_rows * float(1 << 30)) / F.col("n")

    def fit(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part = fit_tree(_matrix(rows.column("vec").combine_chunks()), branch, exponent=exponent, once=True)
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([pickle.dumps(part)], pa.binary())})

    found = (index.join(named, "leaf").where(drawn).select("leaf", "vec")
             .groupBy("leaf").applyInArrow(fit, "leaf int, part binary").collect())
    return {r["leaf"]: pickle.loads(r["part"]) for r in found}


def _calibrate(tree: Tree, index: DataFrame, queries: DataFrame, k: int, recall: float) -> int:
    """Leaf visits at which best-bin-first covers ``recall`` of the exact
    neighbours of ``queries`` (a bounded number) over the whole index."""
    asked = queries.select("vec_id", "vec").toArrow()
    if not asked.num_rows:
        return 1
    q, q_ids = _matrix(asked.column("vec").combine_chunks()), asked.column("vec_id").to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                i, j, score = nearest_rows(q, q_ids, _matrix(part.column("vec")), ids, k)
                leaf = part.column("leaf").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids[j]), pa.array(score),
                                                  pa.array(leaf[j])], ["query_id", "vec_id", "score", "leaf"])

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    exact = (index.mapInArrow(scan, "query_id long, vec_id long, score double, leaf int")
             .withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
             .select("query_id", "leaf").collect())  # k rows for each calibration query
    if not exact:
        return 1
    wanted: dict[int, list[int]] = {}
    for r in exact:
        wanted.setdefault(r["query_id"], []).append(r["leaf"])
    needed = []
    for i, v in zip(q_ids.tolist(), q):
        missing = wanted.get(i, [])
        for n, leaf in enumerate(bins(tree, v), 1):
            needed.extend([n] * missing.count(leaf))
            missing = [x for x in missing if x != leaf]
            if not missing:
                break
    needed = np.sort(needed)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
