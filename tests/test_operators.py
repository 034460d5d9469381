"""Operator unit tests on small hand-made frames (nulls, blanks, multi-valued
cells, name collisions, ties)."""

import pytest
from pyspark.sql import functions as F

from flagloom.functions import capitalize, extract_int, is_missing, safe_name
from flagloom.operators import aggregate as agg
from flagloom.operators import clean, columns, dedupe, derive, encode, rank, reshape
from flagloom.operators.setops import union_all


@pytest.fixture(params=["true", "false"], ids=["ansi_on", "ansi_off"])
def ansi(spark, request):
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", old)


@pytest.fixture
def flags_mixed(spark):
    rows = [(1, True, 1, " TRUE "), (2, False, 0, "false"), (3, None, None, "7"),
            (4, True, 1, "x"), (5, False, None, ""), (6, None, 0, None)]
    return spark.createDataFrame(rows, "id long, a boolean, b int, c string")


@pytest.fixture
def tags(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a, b"), (5, "a,b , c"), (6, "b, b")]
    return spark.createDataFrame(rows, "id long, tags string")


def by_id(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


# -- names ------------------------------------------------------------------

def test_safe_name_rules():
    assert safe_name(" Stand-Up Comedy & Talk Shows ") == "Stand_Up_Comedy_and_Talk_Shows"
    assert safe_name("Faith & Spirituality...") == "Faith_and_Spirituality"
    assert safe_name("Children's TV/Kids") == "Childrens_TV_Kids"
    assert safe_name("A, B") == "A_B"
    assert safe_name("A, B", keep_commas=True) == "A,_B"


def test_safe_name_col_matches_driver_form(spark):
    values = [" Sci-Fi & Fantasy ", "TV-Y7-FV", "Children's TV/Kids", "a.b,c"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    from flagloom.functions import safe_name_col
    got = [r[0] for r in df.select(safe_name_col("v")).collect()]
    assert got == [safe_name(v) for v in values]


def test_one_hot_name_collision_is_an_error(spark):
    df = spark.createDataFrame([(1, "Not found"), (2, "Not Found")], "id long, r string")
    with pytest.raises(ValueError, match="collision"):
        encode.one_hot(df, "r")


# -- cleaning ---------------------------------------------------------------

def test_bool_to_int_all_types(spark, flags_mixed, ansi):
    out = clean.bool_to_int(flags_mixed, ["a", "b", "c"])
    got = by_id(out, "a", "b", "c")
    assert got[1] == (1, 1, 1)
    assert got[2] == (0, 0, 0)
    assert got[3] == (None, None, 7)
    assert got[4] == (1, 1, None)
    assert got[5] == (0, None, None)
    assert dict(out.dtypes)["c"] == "int"


def test_boolean_like_columns_one_scan(spark, flags_mixed, ansi):
    out = {r["column"]: r["is_boolean_like"] for r in clean.boolean_like_columns(flags_mixed).collect()}
    assert out == {"id": False, "a": True, "b": False, "c": True}


def test_fill_zero_casts_booleans_first(spark, flags_mixed, ansi):
    out = clean.fill_zero(flags_mixed, ["a", "b"])
    got = by_id(out, "a", "b")
    assert got[3] == (0, 0) and got[6] == (0, 0) and got[1] == (1, 1)


def test_fill_strings_only_touches_strings(spark, flags_mixed, ansi):
    got = by_id(clean.fill_strings(flags_mixed), "a", "c")
    assert got[6] == (None, "Not found")


def test_replace_values_ignores_booleans(spark, flags_mixed, ansi):
    out = clean.replace_values(flags_mixed, {"false": "0"})
    assert by_id(out, "a", "c")[2] == (False, "0")
    gone = by_id(clean.replace_values(flags_mixed, {"false": None, "x": "y"}), "c")
    assert gone[2] == (None,) and None not in (gone[1][0], gone[4][0])


def test_is_missing_tokens(spark, ansi):
    vals = [None, "", "  ", "Not found", " N/A ", "not_found", "Someone"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, d string")
    got = [r[0] for r in df.orderBy("id").select(is_missing("d")).collect()]
    assert got == [True, True, True, True, True, True, False]


def test_normalize_values_case_blind(spark, ansi):
    df = spark.createDataFrame([("India",), ("india",), (" INDIA ",), ("usa",)], "c string")
    assert sorted(r[0] for r in clean.normalize_values(df, "c").collect()) == ["India", "Usa"]
    r = clean.normalize_report(df, "c").first()
    assert (r["raw_count"], r["unique_count"]) == (4, 2)


def test_capitalize_matches_python(spark):
    vals = ["hELLO wORLD", "x", ""]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    assert [r[0] for r in df.select(capitalize("v")).collect()] == [v.capitalize() for v in vals]


def test_map_values_table(spark, ansi):
    df = spark.createDataFrame([(1, "United"), (2, "India"), (3, None)], "id long, c string")
    m = spark.createDataFrame([("United", "USA")], "k string, v string")
    got = by_id(clean.map_values_table(df, "c", m, "k", "v"), "c")
    assert got == {1: ("USA",), 2: ("India",), 3: (None,)}


# -- encoding ---------------------------------------------------------------

def test_multi_hot_trims_and_handles_null(spark, tags, ansi):
    out = encode.multi_hot(tags, "tags", ["a", "b", "c"], sep=",")
    got = by_id(out, "a", "b", "c")
    assert got[1] == (False, False, False)
    assert got[2] == (False, False, False)
    assert got[5] == (True, True, True)
    assert got[6] == (False, True, False)


def test_multi_hot_untrimmed_reproduces_leading_space_miss(spark, tags):
    out = encode.multi_hot(tags, "tags", ["a", "b"], sep=",", trim=False)
    assert by_id(out, "a", "b")[4] == (True, False)


def test_vocabulary_has_no_cap(spark, tags):
    v = {r["value"]: r["n"] for r in encode.vocabulary(tags, "tags", sep=",").collect()}
    assert v == {"a": 3, "b": 3, "c": 1}
    assert encode.vocabulary_list(tags, "tags", sep=",") == ["a", "b", "c"]
    many = spark.range(3000).selectExpr("id", "concat('v', id) v")
    assert len(encode.vocabulary_list(many, "v")) == 3000


def test_one_hot_int_sorted_vocab(spark, ansi):
    df = spark.createDataFrame([(1, "PG-13"), (2, "TV-MA"), (3, None)], "id long, r string")
    out = encode.one_hot(df, "r", as_type="int")
    assert out.columns == ["id", "r", "PG_13", "TV_MA"]
    assert by_id(out, "PG_13", "TV_MA") == {1: (1, 0), 2: (0, 1), 3: (0, 0)}


def test_canonicalize_first_token(spark, ansi):
    df = spark.createDataFrame([(1, "United Kingdom, France"), (2, " India"), (3, None)], "id long, c string")
    out = encode.canonicalize(df, "c", ",", {"United Kingdom": "UK"})
    assert by_id(out, "c") == {1: ("UK",), 2: ("India",), 3: (None,)}


def test_decode_one_hot_priority_and_default(spark, flags_mixed, ansi):
    out = encode.decode_one_hot(flags_mixed, {"a": "A", "b": "B", "c": "C"}, "label", default="none")
    got = by_id(out, "label")
    assert got[1] == ("A",) and got[3] == ("none",) and got[5] == ("none",) and got[6] == ("none",)


def test_row_flag_count_null_modes(spark, flags_mixed, ansi):
    zero = by_id(encode.row_flag_count(flags_mixed, ["a", "b"], "n"), "n")
    strict = by_id(encode.row_flag_count(flags_mixed, ["a", "b"], "n", null_as_zero=False), "n")
    assert zero[1] == (2,) and zero[3] == (0,) and strict[3] == (None,) and strict[2] == (0,)


def test_row_flag_count_of_none_and_of_a_thousand(spark):
    df = spark.range(3).selectExpr("id", *[f"id >= {i % 3} f{i}" for i in range(1000)])
    assert by_id(encode.row_flag_count(df, [f"f{i}" for i in range(1000)], "n"), "n") == {0: (334,), 1: (667,), 2: (1000,)}
    assert by_id(encode.row_flag_count(df, [], "n"), "n")[1] == (0,)


def test_indicator(spark, ansi):
    df = spark.createDataFrame([(1, "Movie"), (2, "TV Show"), (3, None)], "id long, type string")
    out = encode.indicator(df, "type", {"movie": "Movie", "tv_show": "TV Show"})
    assert by_id(out, "movie", "tv_show") == {1: (1, 0), 2: (0, 1), 3: (0, 0)}


# -- derived ------------------------------------------------------------------

def test_extract_int_is_ansi_safe(spark, ansi):
    df = spark.createDataFrame([(1, "90 min"), (2, "3 Seasons"), (3, "x"), (4, None)], "id long, d string")
    got = by_id(df.select("id", extract_int("d", r"(\d+)\s*min").alias("m")), "m")
    assert got == {1: (90,), 2: (None,), 3: (None,), 4: (None,)}


def test_length_class_branches(spark, ansi):
    rows = [(1, 1, 0, 29, None), (2, 1, 0, 30, None), (3, 1, 0, 90, None), (4, 1, 0, 91, None),
            (5, 1, 0, None, None), (6, 0, 1, None, 1), (7, 0, 1, None, 3), (8, 0, 1, None, 4),
            (9, 0, 1, None, None), (10, 0, 0, None, None)]
    df = spark.createDataFrame(rows, "id long, movie int, tv int, m int, s int")
    out = derive.length_class(df, "k", F.col("movie") == 1, "m", F.col("tv") == 1, "s")
    got = {k: v[0] for k, v in by_id(out, "k").items()}
    assert got == {1: "Short", 2: "Medium", 3: "Medium", 4: "Long", 5: "Long", 6: "One_Season",
                   7: "Multi_Season", 8: "Long_Running", 9: "Long_Running", 10: "Unknown"}
    out2 = derive.length_class(df, "k", F.col("movie") == 1, "m", F.col("tv") == 1, "s",
                               movie_null="Unknown", tv_null="Unknown")
    assert by_id(out2, "k")[5] == ("Unknown",)


def test_decade_and_period_labels(spark, ansi):
    df = spark.createDataFrame([(1, 1949), (2, 1950), (3, 1999), (4, 2019), (5, 2020), (6, 2031), (7, None)],
                               "id long, y int")
    got = by_id(df.select("id", derive.decade_label("y").alias("d"), derive.period_label("y").alias("p")), "d", "p")
    assert [got[i][0] for i in range(1, 8)] == ["Unknown", "1950s", "1990s", "2010s", "2020s", "2020s", "Unknown"]
    assert got[7][1] == "After 2015" and got[1][1] == "Before 2015"


def test_count_class(spark, ansi):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, None)], "id long, n int")
    got = by_id(df.select("id", derive.count_class("n").alias("c")), "c")
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["Unknown", "Single-Country", "Multi-Country", "Unknown"]


def test_text_date_default_year(spark, ansi):
    df = spark.createDataFrame([(1, "August 4, 2017"), (2, " August 4, 2017"), (3, "Not found"), (4, None)],
                               "id long, d string")
    got = by_id(df.select("id", derive.year_with_default("d", "MMMM d, yyyy", 2000).alias("y")), "y")
    assert got == {1: (2017,), 2: (2017,), 3: (2000,), 4: (2000,)}


# -- dedupe -------------------------------------------------------------------

def test_dedupe_defined_survivor(spark, ansi):
    rows = [(3, "t", 2001, "x"), (1, "t", 2001, "y"), (2, "t", 2002, "z"), (4, None, 2001, "w"), (5, None, 2001, "v")]
    df = spark.createDataFrame(rows, "id long, title string, year int, extra string")
    out = dedupe.dedupe(df, ["title", "year"], ["id"])
    assert out.columns == df.columns
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 4]
    out_desc = dedupe.dedupe(df, ["title", "year"], ["-id"])
    assert sorted(r["id"] for r in out_desc.collect()) == [2, 3, 5]


def test_dedupe_mixed_directions_any_type_and_group_limit(spark):
    rows = [("a", 1, 5, {"k": 1}), ("a", 2, 5, None), ("a", 2, 4, {"k": 2}), ("b", None, 1, None), ("b", 0, None, None)]
    df = spark.createDataFrame(rows, "k string, x int, y int, m map<string,int>")
    out = dedupe.dedupe(df, ["k"], ["-x", "y"])
    assert sorted((r["k"], r["x"], r["y"], r["m"]) for r in out.collect()) == [("a", 2, 4, {"k": 2}), ("b", 0, None, None)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_dup_report_counts_null_tuples(spark, ansi):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), (None, None)], "t string, y int")
    r = dedupe.dup_report(df, ["t", "y"]).first()
    assert (r["total_rows"], r["distinct_rows"], r["duplicate_rows"]) == (4, 3, 1)
    assert r["distinct_rows"] == df.distinct().count()


# -- aggregation ----------------------------------------------------------------

def test_profile_columns(spark, flags_mixed, ansi):
    got = {r["column"]: r["n_null"] for r in agg.profile_columns(flags_mixed).collect()}
    assert got == {"id": 0, "a": 2, "b": 2, "c": 1}


def test_flag_totals_mixed_types(spark, flags_mixed, ansi):
    got = {r["flag"]: r["total"] for r in agg.flag_totals(flags_mixed, ["a", "b", "c"]).collect()}
    assert got == {"a": 2, "b": 2, "c": 8}


def test_share_of_total_has_no_driver_round_trip(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "k string")
    out = agg.share_of_total(df, ["k"], digits=1)
    assert {r["k"]: r["percentage"] for r in out.collect()} == {"a": 75.0, "b": 25.0}
    out.collect()
    assert "Subquery" in out._jdf.queryExecution().executedPlan().toString()


def test_two_way_pct_keeps_absent_keys(spark, ansi):
    rows = [(1, 0, 1, 0), (1, 0, 1, 1), (0, 1, 1, 0), (0, 0, 1, 0)]
    df = spark.createDataFrame(rows, "movie int, tv int, us int, fr int").withColumn("de", F.lit(0))
    out = agg.two_way_pct_by_flag(df, ["us", "fr", "de"], "movie", "tv", key="country", digits=1)
    got = {r["country"]: (r["a_count"], r["b_count"], r["a_percentage"], r["b_percentage"]) for r in out.collect()}
    assert got["us"] == (2, 1, 66.7, 33.3)
    assert got["fr"] == (1, 0, 100.0, 0.0)
    assert got["de"] == (None, None, None, None)


def test_value_counts_drops_nulls_and_orders(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), (None,), (None,), (None,)], "v string")
    assert [(r[0], r[1]) for r in agg.value_counts(df, "v").collect()] == [("y", 2), ("x", 1)]


# -- reshape / rank -------------------------------------------------------------

def test_unpivot_flags_mixed_types_and_cooccurrence(spark, flags_mixed, ansi):
    long = reshape.unpivot_flags(flags_mixed, ["id"], ["a", "b", "c"], key="k", value="v")
    assert sorted((r["id"], r["k"]) for r in long.collect()) == [
        (1, "a"), (1, "b"), (1, "c"), (4, "a"), (4, "b")]
    pairs = reshape.cooccurrence(flags_mixed, ["a"], ["b", "c"], "l", "r")
    assert sorted((r["l"], r["r"]) for r in pairs.collect()) == [("a", "b"), ("a", "b"), ("a", "c")]


def test_top_n_per_group_tie_break(spark):
    rows = [("US", "Drama", 5), ("US", "Comedy", 5), ("US", "Horror", 1), ("FR", "Drama", 2)]
    df = spark.createDataFrame(rows, "g string, k string, n long")
    out = rank.top_n_per_group(df, ["g"], ["-n", "k"], 1)
    assert sorted((r["g"], r["k"]) for r in out.collect()) == [("FR", "Drama"), ("US", "Comedy")]


def test_top_k_plans_take_ordered(spark):
    df = spark.range(100).withColumn("n", F.col("id") % 7)
    out = rank.top_k(df, ["-n", "id"], 5)
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in out.collect()] == [6, 13, 20, 27, 34]


def test_top_n_measures_joined(spark):
    df = spark.createDataFrame([(0, 0.5, 0.9, 0.1, 0.7)], "cluster int, avg_a double, avg_b double, avg_c double, avg_d double")
    out = rank.top_n_measures(df, ["cluster"], ["avg_a", "avg_b", "avg_c", "avg_d"], 3, joined="top",
                              strip_prefix="avg_")
    assert out.first()["top"] == "b, d, a"


def test_melt(spark):
    m = reshape.melt(spark.createDataFrame([("G", 1, 2)], "r string, a long, b long"), ["r"], ["a", "b"])
    assert m.count() == 2


def test_select_present_and_matching(spark, flags_mixed):
    assert columns.select_present(flags_mixed, ["c", "zz", "a", "c"]).columns == ["c", "a"]
    wide = spark.createDataFrame([(1, 1, 1, 1, 1)], "USA int, India int, TV_14 int, PG int, Not_Found int")
    got = columns.matching(wide, r"^[A-Z]", exclude_prefixes=("TV_", "PG", "Not"), min_length=3)
    assert got == ["USA", "India"]


def test_union_all_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n long, k string")
    b = spark.createDataFrame([("y", 2)], "k string, n long")
    assert sorted(tuple(r) for r in union_all([a, b]).collect()) == [(1, "x"), (2, "y")]


def test_try_int_equals_try_cast(spark, ansi):
    from flagloom.functions import try_int
    vals = ["1", "+3", "-2", " 7 ", "\t8\n", "1.0", "1.5", "1.", ".5", "1e3", "0x10", "", "x", " ",
            "99999999999", "2147483647", "2147483648", "-2147483648", "-2147483649", "007", "1 2",
            "١٢", "\xa05", "\x0b9", "\x7f5", "\x015\x1f", "1_000", "+", "-", "+-1", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    for t in ("int", "bigint", "smallint"):
        got = df.select(try_int("v", t).alias("a"), F.col("v").try_cast(t).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got), t


def test_hot_key_third_of_rows(spark):
    """One key holds a third of the rows: results stay whole and exact, and the
    plans combine map-side before the shuffle."""
    n = 30_000
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
        (F.col("id") % 7).alias("v"))
    out = dedupe.dedupe(df.repartition(8), ["k"], ["id"])
    assert out.count() == 1 + (n - n // 3)
    assert out.where("k = 'hot'").first()["id"] == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    counts = agg.count_by(df, ["k"])
    assert counts.where("k = 'hot'").first()["n"] == n // 3
    assert "partial_count" in counts._jdf.queryExecution().executedPlan().toString()
    top = rank.top_n_per_group(df, ["k"], ["-v", "id"], 2)
    assert top.where("k = 'hot'").count() == 2
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_top_n_salted_only_on_request(spark):
    n_rows = 9_000
    df = spark.range(n_rows).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("cold")).alias("g"),
        (F.col("id") * 7919 % 10007).alias("v"), "id")
    rows = [tuple(r) for r in df.collect()]
    expected = []
    for g in ("hot", "cold"):
        grp = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:1500]
        expected += [(*r, i + 1) for i, r in enumerate(grp)]
    plain = rank.top_n_per_group(df, ["g"], ["-v", "id"], 1500, rank_col="r")
    forced = rank.top_n_per_group(df, ["g"], ["-v", "id"], 1500, rank_col="r", salt_buckets=16)
    for out, salted in ((plain, False), (forced, True)):
        assert sorted(tuple(r) for r in out.collect()) == sorted(expected)
        assert ("_salt" in out._jdf.queryExecution().optimizedPlan().toString()) == salted


def test_convert_boolean_like_only_touches_detected_columns(spark, flags_mixed, ansi):
    out, found = clean.convert_boolean_like(flags_mixed)
    assert found == ["a", "c"]
    types = dict(out.dtypes)
    assert types["a"] == "int" and types["c"] == "int" and types["b"] == "int" and types["id"] == "bigint"
    got = by_id(out, "a", "c")
    assert got[1] == (1, 1) and got[2] == (0, 0) and got[3] == (None, 7)
