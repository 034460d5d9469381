"""Property tests: column helpers agree with their driver-side / reference
definitions on random text (each example is a batch, one Spark job)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flagloom.functions import capitalize, is_missing, safe_name, safe_name_col, try_int

TEXT = st.text(alphabet=st.sampled_from(list("aZ09 -/&.,'\t_+xé") + ["\x7f", "\x01", "١"]), max_size=12)
BATCH = st.lists(TEXT, min_size=1, max_size=40)
SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")


@SETTINGS
@given(values=BATCH)
def test_safe_name_col_equals_driver_rule(spark, values):
    got = [r[0] for r in _frame(spark, values).orderBy("i").select(safe_name_col("v")).collect()]
    assert got == [safe_name(v) for v in values]


@SETTINGS
@given(values=BATCH)
def test_try_int_equals_try_cast(spark, values):
    df = _frame(spark, values)
    rows = df.select(try_int("v").alias("a"), F.col("v").try_cast("int").alias("b"),
                     try_int("v", "bigint").alias("c"), F.col("v").try_cast("bigint").alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows)


@SETTINGS
@given(values=BATCH)
def test_capitalize_matches_python_on_ascii(spark, values):
    vals = [v.encode("ascii", "ignore").decode() for v in values]
    got = [r[0] for r in _frame(spark, vals).orderBy("i").select(capitalize("v")).collect()]
    assert got == [v.capitalize() for v in vals]


@SETTINGS
@given(values=BATCH)
def test_is_missing_definition(spark, values):
    got = [r[0] for r in _frame(spark, values).orderBy("i").select(is_missing("v")).collect()]
    tokens = {"", "not found", "not_found", "n/a"}
    assert got == [v.strip(" ").lower() in tokens for v in values]


ROWS = st.lists(st.tuples(st.sampled_from(["a", "b", "hot", None]), st.sampled_from([1, 2, None]),
                          st.integers(-5, 5)), min_size=1, max_size=60)


def _keyed(spark, rows):
    # unique ids so the survivor / ranking is fully defined
    return spark.createDataFrame([(i, k1, k2, v) for i, (k1, k2, v) in enumerate(rows)],
                                 "id long, k1 string, k2 int, v int")


@SETTINGS
@given(rows=ROWS)
def test_dedupe_matches_brute_force(spark, rows):
    from flagloom.operators import dedupe
    got = sorted(tuple(r) for r in dedupe.dedupe(_keyed(spark, rows), ["k1", "k2"], ["id"]).collect())
    best = {}
    for i, (k1, k2, v) in enumerate(rows):
        best.setdefault((k1, k2), (i, k1, k2, v))
    assert got == sorted(best.values())


@SETTINGS
@given(rows=ROWS, n=st.integers(1, 4), salt=st.sampled_from([None, 3]))
def test_top_n_per_group_matches_brute_force(spark, rows, n, salt):
    from flagloom.operators import rank
    df = _keyed(spark, rows)
    out = rank.top_n_per_group(df, ["k1"], ["-v", "id"], n, rank_col="r", salt_buckets=salt)
    got = sorted(((r["k1"] or ""), r["id"], r["r"]) for r in out.collect())
    expected = []
    for g in {k1 for k1, _, _ in rows}:
        grp = sorted(((-v, i) for i, (k1, _, v) in enumerate(rows) if k1 == g))[:n]
        expected += [((g or ""), i, pos + 1) for pos, (_, i) in enumerate(grp)]
    assert got == sorted(expected)


FLAG_ROWS = st.lists(st.tuples(st.sampled_from([0, 1, None]), st.sampled_from([0, 1, None]),
                               st.sampled_from([0, 1, None]), st.sampled_from([0, 1])), min_size=1, max_size=40)


@SETTINGS
@given(rows=FLAG_ROWS)
def test_two_way_pct_matches_brute_force(spark, rows):
    from decimal import ROUND_HALF_UP, Decimal

    from flagloom.operators import aggregate as agg
    df = spark.createDataFrame(rows, "a int, b int, f1 int, f2 int").withColumn("f3", F.lit(0))
    out = {r["key"]: tuple(r)[1:] for r in
           agg.two_way_pct_by_flag(df, ["f1", "f2", "f3"], "a", "b", digits=1).collect()}

    def pct(x, tot):
        if tot == 0:
            return None
        return float(Decimal(repr(x / tot * 100)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))

    for k, col in (("f1", 2), ("f2", 3), ("f3", None)):
        sel = [r for r in rows if col is not None and r[col] == 1]
        if not sel:
            assert out[k] == (None, None, None, None)
            continue
        sa = sum(r[0] for r in sel if r[0] is not None) if any(r[0] is not None for r in sel) else None
        sb = sum(r[1] for r in sel if r[1] is not None) if any(r[1] is not None for r in sel) else None
        tot = (sa + sb) if sa is not None and sb is not None else None
        exp = (sa, sb, None if tot is None else pct(sa, tot), None if tot is None else pct(sb, tot))
        assert out[k] == exp, (k, out[k], exp)


@SETTINGS
@given(years=st.lists(st.one_of(st.none(), st.integers(1900, 2040)), min_size=1, max_size=40))
def test_decade_label_matches_definition(spark, years):
    from flagloom.operators import derive
    df = spark.createDataFrame([(i, y) for i, y in enumerate(years)], "i long, y int")
    got = [r[0] for r in df.orderBy("i").select(derive.decade_label("y")).collect()]

    def label(y):
        if y is None or y < 1950:
            return "Unknown"
        return "2020s" if y >= 2020 else f"{y // 10 * 10}s"
    assert got == [label(y) for y in years]


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), min_size=1, max_size=50))
def test_metrics_match_spark_evaluator(spark, pairs):
    import math

    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from flagloom.operators import metrics
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, prediction double")
    ours = metrics.classification_metrics(df).first()
    for name, col in (("accuracy", "accuracy"), ("weightedPrecision", "weighted_precision"),
                      ("weightedRecall", "weighted_recall"), ("f1", "weighted_f1")):
        ref = MulticlassClassificationEvaluator(metricName=name).evaluate(df)
        assert math.isclose(ours[col], ref, rel_tol=1e-9, abs_tol=1e-12), (name, ours[col], ref)


@SETTINGS
@given(keys=st.lists(st.sampled_from(["x", "y", "z", None]), min_size=1, max_size=60))
def test_share_of_total_matches_brute_force(spark, keys):
    from collections import Counter
    from decimal import ROUND_HALF_UP, Decimal

    from flagloom.operators import aggregate as agg
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: (r["count"], r["percentage"]) for r in agg.share_of_total(df, ["k"], digits=3).collect()}
    c = Counter(keys)
    exp = {k: (n, float(Decimal(repr(n / len(keys) * 100)).quantize(Decimal("0.001"), rounding=ROUND_HALF_UP)))
           for k, n in c.items()}
    assert got == exp


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["Movie", "TV Show", None]), st.one_of(st.none(), st.integers(0, 200)),
                               st.one_of(st.none(), st.integers(0, 6))), min_size=1, max_size=40))
def test_length_class_matches_definition(spark, rows):
    from flagloom.operators import derive
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, t string, m int, s int")
    out = derive.length_class(df, "k", F.col("t") == "Movie", "m", F.col("t") == "TV Show", "s")
    got = [r["k"] for r in out.orderBy("i").collect()]

    def label(t, m, s):
        if t == "Movie":
            return "Long" if m is None else "Short" if m <= 29 else "Medium" if m <= 90 else "Long"
        if t == "TV Show":
            return ("Long_Running" if s is None else "One_Season" if s == 1 else
                    "Multi_Season" if 2 <= s <= 3 else "Long_Running")
        return "Unknown"
    assert got == [label(*r) for r in rows]


@SETTINGS
@given(rows=st.lists(st.tuples(*[st.sampled_from([0, 1, None])] * 4), min_size=1, max_size=30))
def test_cooccurrence_matches_brute_force(spark, rows):
    from collections import Counter

    from flagloom.operators import reshape
    df = spark.createDataFrame(rows, "l1 int, l2 int, r1 int, r2 int")
    pairs = reshape.cooccurrence(df, ["l1", "l2"], ["r1", "r2"], "l", "r")
    got = Counter((p["l"], p["r"]) for p in pairs.collect())
    exp = Counter((ln, rn) for row in rows
                  for ln, lv in zip(("l1", "l2"), row[:2]) if lv == 1
                  for rn, rv in zip(("r1", "r2"), row[2:]) if rv == 1)
    assert got == exp


CELL = st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "c d", " a", "b ", ""]), max_size=4).map(",".join))


@SETTINGS
@given(cells=st.lists(CELL, min_size=1, max_size=30))
def test_multi_hot_matches_python(spark, cells):
    from flagloom.operators import encode
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i long, t string")
    vocab = ["a", "b", "c d"]
    out = encode.multi_hot(df, "t", vocab, sep=",", names={"a": "fa", "b": "fb", "c d": "fc"}).orderBy("i")
    got = [(r["fa"], r["fb"], r["fc"]) for r in out.collect()]

    def flags(c):
        toks = set() if c is None else {t.strip(" ") for t in c.split(",")} - {""}
        return tuple(v in toks for v in vocab)
    assert got == [flags(c) for c in cells]


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.sampled_from([1, 2, None])), min_size=1, max_size=40))
def test_dup_report_matches_python(spark, rows):
    from flagloom.operators import dedupe
    df = spark.createDataFrame(rows, "t string, y int")
    r = dedupe.dup_report(df, ["t", "y"]).first()
    assert (r["total_rows"], r["distinct_rows"], r["duplicate_rows"]) == (len(rows), len(set(rows)), len(rows) - len(set(rows)))


@SETTINGS
@given(keys=st.lists(st.integers(-10**12, 10**12), min_size=1, max_size=50, unique=True), seed=st.integers(0, 99))
def test_hash_bucket_matches_python_md5(spark, keys, seed):
    import hashlib

    from flagloom.operators import ml
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["bucket"] for r in ml.hash_split(df, "k", 0.8, seed).collect()}
    exp = {k: int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:8], 16) for k in keys}
    assert got == exp


@SETTINGS
@given(days=st.lists(st.one_of(st.none(), st.integers(0, 20000)), min_size=1, max_size=30),
       pad=st.sampled_from(["", " ", "  "]))
def test_text_date_year_matches_python(spark, days, pad):
    import datetime as dt

    from flagloom.operators import derive
    base = dt.date(1970, 1, 1)
    texts = [None if d is None else pad + (base + dt.timedelta(days=d)).strftime("%B %-d, %Y") for d in days]
    texts = [t if i % 5 else "Not found" for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = [r[0] for r in df.orderBy("i").select(derive.year_with_default("t", "MMMM d, yyyy", 2000)).collect()]

    def year(t):
        try:
            return dt.datetime.strptime(t.strip(" "), "%B %d, %Y").year
        except (TypeError, ValueError, AttributeError):
            return 2000
    assert got == [year(t) for t in texts]
