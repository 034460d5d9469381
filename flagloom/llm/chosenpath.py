"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles; two link when their sets'
Jaccard similarity reaches a threshold. Equal sets are one class, so copies
never become pairs. Every class carries a fixed number of minwise tokens (the
minima of independent hashes of its set). A forest of independent trees then
branches the classes: a node's members are dealt to children by the value of a
token that the node chooses.

* A small node is compared exhaustively, in one task.
* A large node whose children would not shrink (the branches times the chance
  that two members share a token is one or more) is dense: branching on costs
  more than comparing it. It is cut into blocks and every pair of blocks is a
  small node of its own, the pairs within a block first; pairs of different
  blocks only count where no link found so far joins them already.
* Other large nodes branch again.

Trees are repeated so that a pair at the threshold is missed with a chance of
about 1e-7 (two at the threshold share the first token of a tree with that
same probability, so ``(1 - threshold) ** trees`` and a little for deeper
nodes). Members are first compared by all their tokens, with a margin that a
linked pair misses with a chance of 1e-9 at most; only those that may have a
partner in the node go on. Their texts are shingled again and compared as
full sets, which decides every link. Most other texts stay where they are: a
table of at most ``2 ** 20`` numbers of texts in demand leaves them out before
the texts are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagloom.llm.common import Words, mix, settle, shuffle_partitions, slices, whole_groups
from flagloom.llm.components import connected_components

_SPREAD = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PAIRS = 1 << 16
_NUMBERS = 1 << 20


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text (A-Z lower-cased; fewer words: the whole sequence)."""
    words = Words(texts, lower=True)
    base, counts = words.identities(), np.diff(words.first)
    many = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(many)))
    doc = np.repeat(np.arange(len(counts)), many)
    start = words.first[:-1][doc] + np.arange(bounds[-1]) - bounds[:-1][doc]
    size = np.minimum(counts, shingle)[doc]
    h = size.astype(np.uint64)
    for j in range(shingle):
        at = np.minimum(start + j, max(len(base) - 1, 0))
        h += np.where(j < size, base[at] * _SPREAD[j], np.uint64(0)) if len(base) else np.uint64(0)
    h = mix(h)
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def signatures(found: list[np.ndarray], tokens: int) -> list[bytes | None]:
    """``tokens`` minwise tokens of 32 bits of every set; none for an empty one."""
    some = [x for x in found if len(x)]
    if not some:
        return [None] * len(found)
    data = np.concatenate(some)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in some])[:-1]))
    out = np.empty((len(some), tokens), np.uint32)
    for i in range(tokens):
        a, b = mix(np.arange(2 * i + 101, 2 * i + 103, dtype=np.uint64))
        out[:, i] = np.minimum.reduceat((data * (a | np.uint64(1)) + b) >> np.uint64(32), starts)
    rows = iter(out)
    return [next(rows).tobytes() if len(x) else None for x in found]


def least_matches(percent: int, tokens: int, miss: float = 1e-9) -> int:
    """Equal tokens that a pair at the threshold has but for a chance of ``miss``."""
    p, below = percent / 100, 0.0
    for k in range(tokens + 1):
        below += comb(tokens, k) * p ** k * (1 - p) ** (tokens - k)
        if below > miss:
            return k
    return tokens


def _sift(percent: int, tokens: int, trees: int):
    """Members of each cell that may have a partner there whom they have not met in an earlier tree."""
    need, bit = least_matches(percent, tokens), 1 << np.arange(trees, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell"):
            cell, tree, met, n, group = (t.column(c).to_numpy() for c in ("cell", "tree", "met", "n", "part"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(cell), tokens)
            active, left, shift = np.zeros(len(cell), bool), np.arange(len(cell)), 0
            while True:
                shift += 1
                left = left[left + shift < len(cell)]
                left = left[cell[left] == cell[left + shift]]
                if not len(left):
                    break
                for at in range(0, len(left), _PAIRS):
                    i = left[at:at + _PAIRS]
                    j = i + shift
                    fits = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (group[i] != group[j])
                    i, j = i[fits], j[fits]
                    same = sig[i] == sig[j]
                    earlier = met[i] & met[j] & ((np.int64(1) << tree[i].astype(np.int64)) - 1)
                    fits = (same.sum(axis=1) >= need) & ((same[:, :trees] @ bit & earlier) == 0)
                    active[i[fits]] = True
                    active[j[fits]] = True
            pick = pa.array(np.flatnonzero(active))
            yield pa.RecordBatch.from_arrays(
                [t.column(c).combine_chunks().take(pick) for c in ("cell", "digest")], ["cell", "digest"])

    return run


def _linked(found: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets link, as a square of booleans."""
    m, size = len(found), np.array([len(x) for x in found], np.int64)
    both = np.zeros((m, m), np.int64)
    names, which, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(m), size)
    keep = times[which] > 1
    column, owner = shared[which[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(256, (1 << 21) // m)
    for low in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        flags = np.zeros((m, width), np.float32)
        flags[owner[a:b], column[a:b] - low] = 1
        both += (flags @ flags.T).astype(np.int64)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def _confirm(shingle: int, percent: int):
    """Links of every cell on full sets, as stars: each member and the first of its component in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "cell"):
            found = [s for part in t.to_batches() for piece in slices(iter([part]), "text")
                     for s in shingle_sets(piece.column("text"), shingle)]
            names = t.column("digest").to_pylist()
            cell = t.column("cell").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)).tolist()
            a_side, b_side = [], []
            for a, b in zip(cuts, cuts[1:]):
                # a text met by a clash of two rows' hashes does not have its class's set
                rows = sorted({names[r]: r for r in range(a, b) if _digest(found[r]) == names[r]}.values(), key=names.__getitem__)
                if len(rows) < 2:
                    continue
                links, loose = _linked([found[r] for r in rows], percent), np.ones(len(rows), bool)
                for first in range(len(rows)):
                    if not loose[first]:
                        continue
                    reach = front = np.arange(len(rows)) == first
                    while front.any():
                        front = links[front].any(axis=0) & ~reach
                        reach = reach | front
                    loose &= ~reach
                    others = [names[rows[x]] for x in np.flatnonzero(reach).tolist() if x != first]
                    a_side.extend([names[rows[first]]] * len(others))
                    b_side.extend(others)
            yield pa.RecordBatch.from_arrays([pa.array(a_side, pa.binary()), pa.array(b_side, pa.binary())], ["a", "b"])

    return run


def _sets_of(shingle: int, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = shingle_sets(batch.column("_text"), shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_tag"), pa.array([len(x) for x in found], pa.int64()),
                 pa.array([_digest(x) if len(x) else None for x in found], pa.binary()),
                 pa.array(signatures(found, tokens), pa.binary())], ["_id", "_tag", "n", "digest", "sig"])

    return run


def _token(i) -> F.Column:
    """Minwise token number ``i`` out of the packed signature."""
    return F.substring(F.col("sig"), F.lit(4) * i + 1, F.lit(4))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 85, trees: int = 10, tokens: int = 64, node_rows: int = 2048,
                    branches: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles`` (set size),
    ``component_id`` (the smallest id reachable over links of at least
    ``percent`` % Jaccard similarity, its own included) and ``kept`` (whether that
    is its own id).

    A text with fewer words than a shingle is one shingle of all of them. Null,
    empty and blank texts have an empty set and link with nothing, not even
    with each other. Repeated rows give repeated results; a null id keeps its
    row and is no component's id unless all members' ids are null; no rows give
    none. Other columns are ignored. ``node_rows`` bounds the members that one
    task compares, ``trees`` and ``branches`` set the recall.
    """
    if not 0 < trees < min(tokens, 63):
        raise ValueError("trees must be fewer than tokens, and 62 at most")
    parts = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("_tag"))
    kind = rows.schema["_id"].dataType.simpleString()
    prints = settle(rows.mapInArrow(_sets_of(shingle, tokens), f"_id {kind}, _tag long, n long, digest binary, sig binary"),
                    "path-prints")
    classes = settle(prints.where("n > 0").groupBy("digest").agg(
        F.min("_id").alias("first_id"), F.min("_tag").alias("tag"), F.min("n").alias("n"), F.min("sig").alias("sig")),
        "path-classes")

    # first branching of every tree; members that are alone there are done
    first = F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), _token(F.lit(t))).alias("node"))
                      for t in range(trees)])
    dealt = classes.select("digest", F.explode(first).alias("x")).select("digest", "x.tree", "x.node")
    nodes = _sized(dealt)
    leaves, dense, depth = [], [], 0
    while True:
        nodes = settle(nodes, "path-nodes")
        leaves.append(nodes.where(F.col("size") <= node_rows).withColumn("depth", F.lit(depth)))
        large = nodes.where(F.col("size") > node_rows)
        if large.isEmpty():
            break
        token = F.lit(trees) + F.pmod(F.xxhash64("node", "j"), F.lit(tokens - trees)).cast("int")
        below = (large.join(classes.select("digest", "sig"), "digest")
                 .withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(branches))))
                 .select("digest", "tree", "node", "size", F.xxhash64("node", "j", token, _token(token)).alias("child")))
        below = settle(below, "path-branches")
        shared = (below.groupBy("node", "size", "child").agg(F.count("*").cast("double").alias("m"))
                  .groupBy("node").agg((F.sum(F.col("m") * F.col("m")) / F.max(F.col("size") * F.col("size"))).alias("kept")))
        spread = settle(shared, "path-spread")  # branches times the chance that two members stay together
        dense.append(large.join(spread.where("kept >= 1").select("node"), "node")
                     .withColumn("depth", F.lit(depth)))
        nodes = _sized(below.join(spread.where("kept < 1").select("node"), "node")
                       .select("digest", "tree", F.col("child").alias("node")).distinct())
        depth += 1

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    # cells of members to compare; members of one part of a cell are not compared there
    alone = F.xxhash64("digest").alias("part")
    cells = union(leaves).select(F.col("node").alias("cell"), "digest", "tree", alone)
    top = leaves[0].select("digest", "tree")
    if dense:
        # half a node's rows a block, so that two blocks make a small node
        blocks = (union(dense).withColumn("blocks", F.ceil(F.col("size") * 2 / node_rows).cast("int"))
                  .withColumn("own", F.pmod(F.xxhash64("digest", "node"), F.col("blocks")).cast("int")))
        blocks = settle(blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "path-blocks")
        cell = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
        cells = cells.unionByName(blocks.select(cell.alias("cell"), "digest", "tree", F.when(
            F.col("own") == F.col("other"), F.xxhash64("digest")).otherwise(F.col("own")).alias("part")))
        top = top.unionByName(blocks.where("depth = 0 AND own = other").select("digest", "tree"))
    # trees in which a class's first node is compared as a whole: its members have met there
    met = settle(top.groupBy("digest").agg(F.bit_or(F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.col("tree"))).alias("met")), "path-met")

    members = (cells.join(classes.select("digest", "sig", "n"), "digest").join(met, "digest", "left")
               .select("cell", "digest", "tree", F.coalesce("met", F.lit(0).cast("long")).alias("met"), "n", "part", "sig")
               .repartition(parts, "cell").sortWithinPartitions("cell"))
    active = settle(members.mapInArrow(_sift(percent, tokens, trees), "cell long, digest binary"), "path-active")
    wanted = settle(active.select("digest").distinct()
                    .join(classes.select("digest", F.col("tag").alias("_tag")), "digest"), "path-wanted")
    demand = F.broadcast(wanted.select(_number(F.col("_tag")).alias("_number")).distinct())  # of _NUMBERS rows at most
    texts = settle(rows.select("_tag", "_text", _number(F.col("_tag")).alias("_number")).join(demand, "_number", "left_semi")
                   .join(wanted, "_tag").groupBy("digest").agg(F.first("_text").alias("text")), "path-texts")
    whole = active.join(texts, "digest").repartition(parts, "cell").sortWithinPartitions("cell")
    links = settle(whole.mapInArrow(_confirm(shingle, percent), "a binary, b binary"), "path-links")
    roots = connected_components(links)
    named = settle(classes.select("digest", "first_id").join(roots, F.col("digest") == F.col("node"), "left")
                   .select("digest", "first_id", F.coalesce("root", "digest").alias("root")), "path-roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = settle(named.join(least, "root").select("digest", "component_id"), "path-components")
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return (prints.select("_id", "n", "digest").join(found, "digest", "left")
            .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def _number(tag) -> F.Column:
    return F.pmod(tag, F.lit(_NUMBERS)).cast("int")


def _sized(dealt: DataFrame) -> DataFrame:
    """Rows of nodes with two members or more, with the node's ``size``."""
    sizes = dealt.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return dealt.join(sizes, "node").select("digest", "tree", "node", "size")
