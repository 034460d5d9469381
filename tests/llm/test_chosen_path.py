"""Chosen-path similarity join against all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from flagloom.llm import chosenpath

SCHEMA = "doc_id long, text string, n long, digest string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, percent=85, k=5):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets.append({b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    out = []
    for x, (i, _) in enumerate(rows):
        root = least.get(find(x)) if sets[x] else i
        out.append((i, len(sets[x]), root, i == root))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], SCHEMA)
    got = chosenpath.near_duplicates(df, **how)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10 ** 6)}"
    return words


def corpus(seed, groups=12, members=9, size=90):
    rng = random.Random(seed)
    rows, ident = [], 100
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(8, size))]
        for _ in range(members):
            rows.append((ident, " ".join(edited(rng, base, rng.randrange(0, 4)))))
            ident += 1
    for _ in range(40):
        rows.append((ident, " ".join(["one common line of words here"] + [f"w{rng.randrange(5000)}" for _ in range(30)])))
        ident += 1
    rng.shuffle(rows)
    return rows


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a  b\tc d"), (8, "a b c d e"), (9, "é É"),
         (10, "é É"), (None, "no id here at all"), (11, "no id here at all"), (None, "alone without any id"),
         (12, "same id"), (12, "same id"), (12, "same id and other text"), (13, "x " * 3000), (14, "x " * 2999)]


@pytest.mark.parametrize("how", [{}, {"node_rows": 6}, {"node_rows": 4, "branches": 3}])
def test_components_equal_all_pairs(spark, how):
    rows = corpus(3) + EDGES
    assert run(spark, rows, **how) == brute(rows)


def test_dense_nodes_are_compared_in_blocks(spark):
    """A hundred near copies share nearly every token; no branching splits them."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(1, 6)))) for i in range(120)]
    want = brute(rows)
    assert len({r[2] for r in want}) > 1 and max(sum(r[2] == c[2] for r in want) for c in want) > 20
    assert run(spark, rows, node_rows=16) == want


def test_copies_are_one_class(spark):
    rows = [(i, "the very same text in very many copies " * 3) for i in range(400)] + [(900, "something else entirely is here")]
    got = run(spark, rows, node_rows=8)
    assert {r[2] for r in got if r[0] < 400} == {0} and sum(r[3] for r in got) == 2


def test_threshold_is_exact(spark):
    """Sets of 100 and 85 shingles within it are linked, of 100 and 84 are not."""
    words = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:89])), (3, " ".join(f"v{w}" for w in words)),
            (4, " ".join(f"v{w}" for w in words[:88]))]
    assert run(spark, rows) == [(1, 100, 1, True), (2, 85, 1, False), (3, 100, 3, True), (4, 84, 4, True)]


def test_shingle_sets_and_margin():
    texts = pa.array(["A b c d e f", "a B c d e f", None, "x y", "a b c d e f a b c d e"])
    one, two, three, four, five = chosenpath.shingle_sets(texts, 5)
    assert (one == two).all() and len(one) == 2 and len(three) == 0 and len(four) == 1 and len(five) == 6
    assert set(one) <= set(five)
    need = chosenpath.least_matches(85, 64)
    rng = np.random.default_rng(1)
    assert 30 < need < 45 and (rng.binomial(64, 0.85, 200_000) >= need).all()


def test_empty_table(spark):
    assert run(spark, []) == []
