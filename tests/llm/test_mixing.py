"""Source mixing: weights against a plain bisection, budgets and whole passes."""

import math

import pytest
from pyspark.sql import functions as F

from flagloom.llm import mixing

SCHEMA = "doc_id long, source string, text string, mix_pass string"
TOKENS = {"big": 6000, "mid": 1500, "small": 300, None: 90, "tiny": 30}


def docs(spark, per_doc=10):
    rows, i = [], 0
    for s, n in TOKENS.items():
        for _ in range(n // per_doc):
            rows.append((i, s, "w " * per_doc, "clash"))
            i += 1
    return spark.createDataFrame(rows, SCHEMA)


def plain(max_repeats, entropy, budget):
    p = [n / sum(TOKENS.values()) for n in TOKENS.values()]

    def most(x):
        w = [v ** x for v in p]
        r = [a / b for a, b in zip(w, p)]
        return max(r) / min(r) if budget is None else max(r) / sum(w) * budget / sum(TOKENS.values())

    def spread(x):
        w = [v ** x / sum(u ** x for u in p) for v in p]
        return -sum(v * math.log(v) for v in w)

    def least(ok):
        low, high = 0.0, 1.0
        if ok(low):
            return low
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    x = least(lambda x: most(x) <= max_repeats * (1 + 1e-9))
    return max(x, least(lambda x: spread(x) <= entropy * math.log(len(p)))) if entropy is not None else x


@pytest.mark.parametrize("max_repeats, entropy, budget", [(4.0, None, None), (1000.0, 0.8, None), (3.0, 0.9, 4000),
                                                          (2.0, 0.1, None), (1e9, 1.0, None), (1.0, None, None)])
def test_exponent_and_weights(spark, max_repeats, entropy, budget):
    w = {r["source"]: r for r in mixing.mixing_weights(mixing.source_shares(docs(spark)), max_repeats, entropy, budget).collect()}
    x = plain(max_repeats, entropy, budget)
    total = sum(TOKENS.values())
    norm = sum((n / total) ** x for n in TOKENS.values())
    for s, n in TOKENS.items():
        assert w[s]["exponent"] == pytest.approx(x, abs=1e-6)
        assert w[s]["weight"] == pytest.approx((n / total) ** x / norm, abs=1e-6)
        assert w[s]["budget"] <= n * max_repeats + 1
        if budget is None:
            assert w[s]["budget"] >= n - 1


def test_every_row_passes_and_budgets_are_met(spark):
    d = docs(spark)
    weights = {r["source"]: r["budget"] for r in mixing.mixing_weights(mixing.source_shares(d), 4.0, None).collect()}
    got = mixing.mix_sources(d, entropy=None, max_repeats=4.0, least_blocks=512)
    assert got.columns == ["doc_id", "source", "text", "mix_pass", "mix_order", "mix_weight"]
    assert got.select("doc_id").distinct().count() == d.count()
    taken = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    for s, n in weights.items():
        assert abs(taken[s] - n) <= 40
    # a row is taken once a pass at most, and passes leave no gap
    per_row = got.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("mix_pass").alias("m"),
                                        F.max("mix_pass").alias("last")).collect()
    assert all(r["n"] == r["m"] for r in per_row)


def test_stated_budget_samples_by_weight(spark):
    got = mixing.mix_sources(docs(spark), entropy=None, max_repeats=1.0, budget=2000, least_blocks=2048)
    n = got.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(n - 2000) <= 60


def test_defined_cases(spark):
    rows = [(1, "a", None, ""), (2, "a", "", ""), (3, "b", "  ", ""), (4, "c", "one", ""), (4, "c", "one", ""),
            (None, None, "two words", ""), (6, "d", "x " * 50000, "")]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).where("mix_pass = 0").collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "4", "4", "6", "None"]
    assert {r["mix_weight"] for r in got if r["source"] in ("a", "b")} == {0.0}
    assert mixing.mix_sources(docs(spark).limit(0)).count() == 0
    quiet = spark.createDataFrame(rows[:3], SCHEMA)
    assert mixing.mix_sources(quiet).count() == 3


def test_passes_are_different_permutations(spark):
    got = mixing.mix_sources(docs(spark), entropy=None, max_repeats=4.0, least_blocks=256).where("source = 'small'")
    order = {p: [r["doc_id"] for r in got.where(F.col("mix_pass") == p).orderBy("mix_order", "doc_id").collect()]
             for p in (0, 1)}
    assert sorted(order[0]) == sorted(order[1]) and order[0] != order[1]


def test_no_python_on_the_plan(spark):
    plan = mixing.mix_sources(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


EVEN = {"a": 1000, "b": 960, "c": 900, None: 800}


def even(spark, tokens):
    rows = [(i, s, "w " * 10, "") for s, n in tokens.items() for i in range(n // 10)]
    return spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("budget", [None, 1500])
def test_nearly_even_sources_meet_the_target(spark, budget):
    d = even(spark, EVEN)
    w = {r["source"]: r for r in mixing.mixing_weights(mixing.source_shares(d), 20.0, 0.9, budget).collect()}
    low, high = 1.0, 100.0
    for _ in range(100):
        x = (low + high) / 2
        p = [n ** x / sum(m ** x for m in EVEN.values()) for n in EVEN.values()]
        low, high = (low, x) if -sum(v * math.log(v) for v in p) <= 0.9 * math.log(4) else (x, high)
    assert high > 2
    for v, (s, n) in zip(p, EVEN.items()):
        assert w[s]["exponent"] == pytest.approx(high, abs=1e-5)
        assert w[s]["weight"] == pytest.approx(v, abs=1e-6)
        assert w[s]["budget"] <= n * 20 + 1
        if budget is None:
            assert w[s]["budget"] >= n - 1
    if budget:
        assert sum(r["budget"] for r in w.values()) == pytest.approx(budget, abs=2)
    else:
        got = mixing.mix_sources(d, max_repeats=20.0, entropy=0.9, least_blocks=64)
        assert got.select("doc_id").distinct().count() == d.count() and got.count() > d.count()


@pytest.mark.parametrize("tokens, max_repeats, budget", [(EVEN, 1.1, None), (EVEN, 1.0, 3660), (dict.fromkeys("abcd", 500), 4.0, None),
                                                         (dict.fromkeys("abcdefghijklmnopqrst", 500) | {"z": 400}, 4.0, 2000)])
def test_target_out_of_reach_leaves_the_natural_shares(spark, tokens, max_repeats, budget):
    shares = mixing.source_shares(even(spark, tokens))
    w = mixing.mixing_weights(shares, max_repeats, 0.9, budget).collect()
    assert {r["exponent"] for r in w} == {1.0}
