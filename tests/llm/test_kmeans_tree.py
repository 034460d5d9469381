"""Tree search: recall against brute force, exact scores, ties, defined cases."""

import numpy as np
import pyarrow as pa

from flagloom.llm import kmtree

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(f) for f in v], "c") for i, v in zip(ids, x)], SCHEMA)


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "_ROWS", 64)
    monkeypatch.setattr(kmtree, "_QUERIES", 3)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 12)) * 3
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 12))).astype(np.float32)
    ids = rng.permutation(3000)
    got = answers(kmtree.search(frame(spark, x, ids), every=50, leaf_rows=40, sample_rows=1000))
    assert set(got) == {i for i in range(0, 3000, 50)}
    x64, hits = x.astype(np.float64), 0
    at = {int(i): p for p, i in enumerate(ids)}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        want = brute(x64, ids, at[q], 10)
        hits += len({v for v, _ in want} & {v for _, v, _ in found})
        for _, v, s in found:
            assert abs(s - np.sqrt(((x64[at[q]] - x64[at[v]]) ** 2).sum())) < 1e-12
        assert [s for _, _, s in found] == sorted(s for _, _, s in found)
    assert hits / (10 * len(got)) >= 0.9


def test_visiting_every_leaf_is_exact():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6))
    tree = kmtree.fit_tree(x, branch=4, leaf_rows=20)
    leaf = kmtree.descend(tree, x)
    assert leaf.min() >= 0 and len(np.unique(leaf)) == tree.leaves
    for q in x[:20]:
        order = kmtree.best_bins(tree, q, tree.leaves)
        assert sorted(order) == list(range(tree.leaves))
        assert kmtree.best_bins(tree, q, 3) == order[:3]


def test_a_third_of_equal_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "_ROWS", 20)
    x = np.vstack([np.ones((300, 4)), np.random.default_rng(3).normal(size=(600, 4))])
    got = answers(kmtree.search(frame(spark, x, np.arange(900)), every=100, leaf_rows=30))
    assert got[0] == [(i, i, 0.0) for i in range(1, 11)]
    assert got[200] == [(i + 1, i, 0.0) for i in range(10)]


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], ""), (1, [1.0, 1.0], ""), (1, [1.0, 1.0], "repeated"), (2, None, ""), (3, [0.0, 0.0], ""),
            (4, [nan, 1.0], ""), (5, [inf, 1.0], ""), (6, [None, 1.0], ""), (7, [1.0, 2.0, 3.0], ""), (None, [1.0, 0.0], ""),
            (100, [1.0, 0.0], ""), (200, [], ""), (300, None, "")]
    got = answers(kmtree.search(spark.createDataFrame(rows, SCHEMA)))
    assert got == {0: [(1, 100, 0.0), (2, 1, 1.0)], 100: [(1, 0, 0.0), (2, 1, 1.0)]}


def test_no_vectors_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0], ""), (2, [2.0], "")], SCHEMA)
    assert kmtree.search(df).count() == 0
    assert kmtree.search(df.limit(0)).count() == 0
    assert kmtree.search(spark.createDataFrame([(100, [1.0], "")], SCHEMA)).count() == 0


def test_isolated_queries_beside_a_big_group_of_copies(spark):
    # the copies' neighbours are in their own leaf, so the calibrated number of leaves is 1
    x = np.vstack([np.ones((4000, 4)), np.eye(4) * 50, -np.eye(4) * [[70], [80], [90], [100]]])
    ids = np.concatenate([np.arange(1, 4001), [5000, 5001, 5010, 5011, 5012, 5013, 5014, 5015]])
    got = answers(kmtree.search(frame(spark, x, ids), every=10, leaf_rows=30))
    at = {int(i): p for p, i in enumerate(ids)}
    assert set(got) == {i for i in at if i % 10 == 0}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert q not in {v for _, v, _ in found}
        for _, v, s in found:
            assert abs(s - np.sqrt(((x[at[q]] - x[at[v]]) ** 2).sum())) < 1e-12


def test_leaves_past_the_visits_until_enough_rows():
    x = np.vstack([np.zeros((50, 2)), [[10.0, 0.0]], [[11.0, 0.0]], [[30.0, 0.0]]])
    tree = kmtree.fit_tree(x, branch=4, leaf_rows=5)
    rows = np.bincount(kmtree.descend(tree, x), minlength=tree.leaves)
    order = kmtree.best_bins(tree, x[50], tree.leaves)
    assert kmtree.best_bins(tree, x[50], 1, rows, 1) == order[:1]
    assert kmtree.best_bins(tree, x[50], 1, rows, 2) == order[:2]
    assert kmtree.best_bins(tree, x[50], 1, rows, 11) == order[:3]
    assert kmtree.best_bins(tree, x[50], 1, rows, 54) == order  # fewer rows than asked for: every leaf


def test_largest_and_smallest_doubles(spark):
    """Squares of these leave the range of doubles; every query is answered as by exact arithmetic."""
    from fractions import Fraction

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)) * 10.0 ** rng.choice([-300, -162, -20, 0, 3, 160, 200, 300], size=400)[:, None]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = answers(kmtree.search(table, every=50, leaf_rows=50, recall=1.0))
    assert set(got) == set(range(0, 400, 50))
    exact = [[Fraction(v) for v in row] for row in x.tolist()]
    for q, found in got.items():
        near = sorted((sum((a - b) ** 2 for a, b in zip(exact[q], exact[i])), i) for i in range(400) if i != q)[:10]
        assert len(found) == 10
        for (_, v, score), (d, i) in zip(found, near):
            want = sum((a - b) ** 2 for a, b in zip(exact[q], exact[v]))
            assert score == 0 if want == 0 else abs(Fraction(score) ** 2 / want - 1) < Fraction(1, 10 ** 12)
            assert abs(want - d) <= d / 10 ** 9  # as near as the true one, however close the two


def test_distances_past_the_range():
    x = np.array([[1.7e308, 0.0], [5e-324, 0.0], [1e200, 1e200], [3e-200, 4e-200], [3.0, 4.0]])
    got = kmtree.distances(x, np.array([0.0, 0.0]))
    assert got.tolist() == [1.7e308, 5e-324, np.sqrt(2) * 1e200, 5e-200, 5.0] or np.allclose(
        got / np.array([1.7e308, 5e-324, np.sqrt(2) * 1e200, 5e-200, 5.0]), 1, rtol=1e-15)
    assert kmtree.distances(np.array([[1.7e308]]), np.array([-1.7e308])).tolist() == [np.inf]


def test_large_leaves_are_split(spark):
    """200,000 vectors under a tree of a small sample: no leaf keeps more rows than stated, but for copies."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8)) * 6
    x = np.vstack([centres[rng.integers(30, size=197_000)] + rng.normal(size=(197_000, 8)), np.full((3000, 8), 40.0)])
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(200_000), "embedding": list(x)}))
    seen = {}
    calibrate = kmtree._calibrate

    def spy(tree, index, *rest):
        seen["sizes"] = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
        seen["tree"] = tree
        return calibrate(tree, index, *rest)

    kmtree._calibrate = spy
    try:
        got = answers(kmtree.search(table, every=4000, sample_rows=600, leaf_rows=100, most_rows=1000))
    finally:
        kmtree._calibrate = calibrate
    sizes = seen["sizes"]
    assert sum(sizes.values()) == 200_000 and sum(n > 1000 for n in sizes.values()) == 1  # the 3,000 copies
    assert seen["tree"].leaves > 200 and (kmtree.descend(seen["tree"], x[:500]) >= 0).all()
    right = total = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        near = set(np.lexsort((np.arange(len(x)), d))[:10].tolist())
        assert len(found) == 10
        right, total = right + len(near & {v for _, v, _ in found}), total + 10
    assert len(got) == 50 and right / total > 0.9


def test_the_tree_keeps_its_bound(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 3))
    got = answers(kmtree.search(frame(spark, x, np.arange(5000)), every=1000, sample_rows=100, leaf_rows=50, most_rows=10,
                                most_leaves=40))
    assert len(got) == 5 and all(len(v) == 10 for v in got.values())


def test_recall_of_the_registered_query(spark):
    from flagloom.llm.queries import op9_kmeans_tree

    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = answers(op9_kmeans_tree(spark, folder))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    right = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        right += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & {v for _, v, _ in found})
    assert right / (10 * len(got)) >= 0.95
