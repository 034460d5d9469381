"""The composed catalog stages on a small messy catalog."""

import pytest

from flagloom.operators import encode
from flagloom.plans import pipeline
from flagloom.session import scratch_path

RAW = [
    # show_id, type, title, director, country, date_added, release_year, rating, duration, listed_in
    ("s1", "Movie", "A", "Jane Doe", "United States, India", "August 4, 2017", "2014", "PG-13", "90 min",
     "Dramas, Thrillers"),
    ("s2", "TV Show", "B", None, "India", " August 4, 2017", "2021", "TV-MA", "1 Season", "Docuseries"),
    ("s3", "Movie", "A", "Someone", "France", "Not found", "2014", "R", "29 min", "Dramas"),       # dup of s1
    ("s4", "TV Show", "C", " N/A ", None, None, "bad", None, "3 Seasons", "Crime TV Shows, Docuseries"),
    ("s5", None, "D", "Not found", "United Kingdom, France, United States", "May 1, 2019", "1949", "84 min",
     "x min", "Thrillers"),
    ("s6", "Movie", "E", "", "South Korea", "May 1, 2019", "1999", "TV-Y7-FV", "no digits", "Dramas"),
]
SCHEMA = ("show_id string, type string, title string, director string, country string, date_added string, "
          "release_year string, rating string, duration string, listed_in string")
SPEC = pipeline.CatalogSpec(country_map={"United States": "USA", "United Kingdom": "UK"})


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(RAW, SCHEMA)


def test_encode_names_and_flags(raw):
    enc = pipeline.encode_catalog(raw, SPEC)
    assert enc.genre_flags == {"Crime_TV_Shows": "Crime TV Shows", "Docuseries": "Docuseries",
                               "Dramas": "Dramas", "Thrillers": "Thrillers"}
    assert set(enc.rating_flags) == {"84_min", "PG_13", "R", "TV_MA", "TV_Y7_FV"}
    assert set(enc.country_flags.values()) == {"France", "India", "South Korea", "UK", "USA"}
    row = {r["show_id"]: r for r in enc.df.collect()}
    assert row["s1"]["Thrillers"] is True          # second genre found (elements trimmed)
    assert row["s1"]["USA"] == 1 and row["s1"]["India"] == 1
    assert row["s4"]["France"] == 0                # null country sets no flag
    assert "type" not in enc.df.columns and row["s5"]["movie"] == 0 and row["s5"]["tv_show"] == 0


def test_features(raw):
    enc = pipeline.encode_catalog(pipeline.dedupe_catalog(raw, SPEC), SPEC)
    feat = {r["show_id"]: r for r in pipeline.feature_catalog(enc, SPEC).collect()}
    assert set(feat) == {"s1", "s2", "s4", "s5", "s6"}   # s3 duplicates (A, 2014); lowest id survives
    s1, s2, s4, s5, s6 = (feat[k] for k in ("s1", "s2", "s4", "s5", "s6"))
    assert (s1["rating"], s1["duration_min"], s1["content_length_category"]) == ("PG-13", 90, "Medium")
    assert (s2["seasons_num"], s2["content_length_category"]) == (1, "One_Season")
    assert (s4["seasons_num"], s4["content_length_category"], s4["rating"]) == (3, "Multi_Season", "Not_Found")
    assert s5["content_length_category"] == "Unknown" and s5["release_decade"] == "Unknown"
    assert s6["content_length_category"] == "Long"          # unreadable minutes, catalog rule
    assert s4["release_decade"] == "Unknown" and s2["release_decade"] == "2020s" and s6["release_decade"] == "1990s"
    assert [feat[k]["content_origin"] for k in ("s1", "s2", "s4", "s5", "s6")] == \
        ["Licensed", "Original", "Original", "Original", "Original"]
    assert (s1["country_count"], s1["multi_country_production"]) == (2, "Multi-Country")
    assert (s5["country_count"], s4["multi_country_production"]) == (3, "Unknown")
    assert s2["Docuseries"] == 1 and isinstance(s2["TV_MA"], int)


def test_explicit_null_labels(raw):
    enc = pipeline.encode_catalog(raw, SPEC)
    feat = {r["show_id"]: r for r in pipeline.feature_catalog(enc, SPEC, movie_null="Unknown").collect()}
    assert feat["s6"]["content_length_category"] == "Unknown"


def test_long_form_equals_wide_form(raw):
    clean = pipeline.dedupe_catalog(raw, SPEC)
    cols = ["show_id", "movie", "tv_show", *pipeline.FEATURE_COLUMNS]
    wide = pipeline.feature_catalog(pipeline.encode_catalog(clean, SPEC), SPEC)
    long = pipeline.catalog_rows(clean, SPEC)
    assert sorted(map(str, long.select(*cols).collect())) == sorted(map(str, wide.select(*cols).collect()))


def test_two_thousand_countries(spark):
    rows = [(f"s{i}", "Movie" if i % 2 else "TV Show", f"t{i}", None, f"c{i % 2000}, c{(i * 7) % 2000}", None, "2000",
             "R", "90 min", "Dramas, Thrillers") for i in range(4000)]
    df = pipeline.catalog_rows(spark.createDataFrame(rows, SCHEMA), SPEC)
    assert pipeline.top_genre_per_country(df).count() == 2000
    share = pipeline.type_share_by_country(df).collect()
    assert len(share) == 2000 and sum(r["movie_count"] + r["tvshow_count"] for r in share) == df.selectExpr("sum(country_count)").first()[0]


def test_rating_share_shuffles_no_flags(raw):
    report = pipeline.rating_share(pipeline.catalog_rows(pipeline.dedupe_catalog(raw, SPEC), SPEC))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Dramas" not in plan and "India" not in plan


def test_reports(raw):
    rows = pipeline.catalog_rows(pipeline.dedupe_catalog(raw, SPEC), SPEC)
    top = {r["country"]: (r["genre"], r["count"]) for r in pipeline.top_genre_per_country(rows).collect()}
    assert top["India"] == ("Docuseries", 1) and top["USA"] == ("Thrillers", 2)
    share = {r["country"]: r for r in pipeline.type_share_by_country(rows).collect()}
    assert (share["India"]["movie_count"], share["India"]["tvshow_count"], share["India"]["movie_percentage"]) == (1, 1, 50.0)
    assert share["UK"]["movie_percentage"] is None       # only a title of neither type
    r = {x["rating"]: x["percentage"] for x in pipeline.rating_share(rows).collect()}
    assert r["PG-13"] == 20.0


def test_model_input_and_stage_handoff(spark, raw):
    enc = pipeline.encode_catalog(pipeline.dedupe_catalog(raw, SPEC), SPEC)
    feat = pipeline.feature_catalog(enc, SPEC)
    written = pipeline.write_stage(feat, scratch_path(spark, "stage2"))
    assert written.count() == 5
    cols = ["movie", "tv_show", *enc.genre_flags, "duration_min", "seasons_num", "country_count", "release_year"]
    x = {r["show_id"]: r for r in pipeline.model_input(written, cols, SPEC).collect()}
    assert x["s4"]["release_year"] == 2000 and x["s4"]["year_added"] == 2000
    assert x["s2"]["year_added"] == 2017
    assert len(x["s1"]["features"]) == len(cols)


def test_vocabulary_lists_one_scan(spark, raw):
    v = encode.vocabulary_lists(raw, {"g": ("listed_in", ","), "r": ("rating", None)})
    assert v["g"] == ["Crime TV Shows", "Docuseries", "Dramas", "Thrillers"]
    assert v["r"] == ["84 min", "PG-13", "R", "TV-MA", "TV-Y7-FV"]


def test_collide_fixture_raises(spark):
    df = spark.createDataFrame([(1, "A-B"), (2, "A B"), (3, "A/B")], "id long, r string")
    with pytest.raises(ValueError, match="collision"):
        encode.one_hot(df, "r")
