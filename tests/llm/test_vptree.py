"""Vantage-point tree clustering against plain rounds over all pairs, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from flagloom.llm import vptree

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string"
LONG = (1 << 63) - 1


def brute(rows, size, k, rounds, scale=256, salt="2"):
    kept = [(i, [x if isinstance(x, float) else float(x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in v] for _, v in kept]
    order = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v, n) for n, (i, v) in enumerate(kept) if i is not None)
    centres = [ints[n] for _, _, n in order[:k]]
    if not centres:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres)) for x in ints]

    for _ in range(rounds):
        near = assign()
        for j in range(len(centres)):
            own = [x for x, (_, c) in zip(ints, near) if c == j]
            if own:
                centres[j] = [sum(col) // len(own) for col in zip(*own)]
    near = assign()
    fits = lambda v: v if v <= LONG else None
    sums = {}
    for d, c in near:
        sums.setdefault(c, []).append(d)
    total = {c: fits(sum(v)) if max(v) <= LONG else None for c, v in sums.items()}
    every = fits(sum(d for d, _ in near)) if all(d <= LONG for d, _ in near) else None
    sha = {c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest() for c in sums}
    return sorted(((i, c, fits(d), total[c], every, sha[c]) for (i, _), (d, c) in zip(kept, near)), key=str)


def run(spark, rows, **how):
    got = vptree.cluster(spark.createDataFrame([(i, v, "", "") for i, v in rows], SCHEMA), **how)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def vectors(seed, n, size, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(i % 5, spread) for _ in range(size)]) for i in range(n)]


@pytest.mark.parametrize("seed,k", [(1, 7), (2, 1), (3, 12)])
def test_equal_to_plain_rounds(spark, seed, k):
    rows = vectors(seed, 150, 6)
    assert run(spark, rows, size=6, k=k, rounds=4) == brute(rows, 6, k, 4)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(4, 40, 3) + [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [nan, 1.0, 1.0]),
                                (105, [inf, 0.0, 0.0]), (106, [0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (107, [-0.0, 0.0, 1e-300]),
                                (3, [9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0]), (108, [-1.001, -0.001, 0.0])]
    assert run(spark, rows, size=3, k=6, rounds=3) == brute(rows, 3, 6, 3)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]  # equal vectors start several centroids
    assert run(spark, rows, size=2, k=10, rounds=2) == brute(rows, 2, 10, 2)
    grid = [(i, [float(i % 7), float(i // 7)]) for i in range(49)]
    assert run(spark, grid, size=2, k=9, rounds=3, scale=2) == brute(grid, 2, 9, 3, scale=2)


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1.0, 1e9, -1e16, 3e38, 1e300, 1.7e308]) * rng.random() for _ in range(3)]) for i in range(40)]
    assert run(spark, rows, size=3, k=5, rounds=3) == brute(rows, 3, 5, 3)
    rows = [(i, [rng.uniform(-4e5, 4e5) for _ in range(4)]) for i in range(60)]  # on either side of the small range
    rows += [(100 + i, [rng.uniform(-6e5, 6e5) for _ in range(4)]) for i in range(20)]
    assert run(spark, rows, size=4, k=4, rounds=2) == brute(rows, 4, 4, 2)


def test_few_and_none(spark):
    rows = vectors(6, 3, 4)
    assert run(spark, rows, size=4, k=40, rounds=2) == brute(rows, 4, 40, 2)
    assert run(spark, [], size=4) == [] == run(spark, [(None, [1.0] * 4)], size=4)
    with pytest.raises(ValueError):
        run(spark, rows, size=65)


def test_floats(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors(7, 50, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vptree.cluster(df, size=5, k=4, rounds=2).collect()), key=str) == brute(rows, 5, 4, 2)


def test_the_tree_prunes_and_is_exact():
    rng = np.random.default_rng(2)
    centres = [list(map(int, c)) for c in rng.integers(-1000, 1000, (40, 3))]
    tree = vptree.VantageTree(centres)
    x = rng.integers(-1200, 1200, (500, 3))
    d = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
    which, best = tree.nearest_rows(x)
    assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    visits = 0
    plain = tree.squared

    def counted(v, number):
        nonlocal visits
        visits += 1
        return plain(v, number)

    tree.squared = counted
    assert [tree.nearest(v) for v in x.tolist()] == list(zip(which.tolist(), best.tolist()))
    assert visits < 0.8 * 40 * 500
