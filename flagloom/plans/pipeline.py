"""The catalog analysis as composable stages.

Raw rows are de-duplicated first (``dedupe_catalog``), so nothing derived is
carried through that shuffle. ``catalog_rows`` is the long form: type
indicators, countries and genres as arrays, and the features (rating label,
duration / seasons, length class, origin class, decade, country count and
class). Reports (top genre per country, type share per country, rating share)
explode those arrays and need no vocabulary.

The wide form is for models: ``encode_catalog`` turns genres, ratings and
countries into flag columns, ``feature_catalog`` derives the same features
from the flags, ``model_input`` parses the text date, casts the year, fills
zeros and assembles the vector. Its vocabularies are parameters; a missing one
is taken to be a dictionary and read from the data.

``write_stage`` persists a stage as Parquet (typed, column-pruned on re-read)
when lineage should be cut between stages.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagloom.functions.names import safe_name
from flagloom.functions.scalars import TEXT_DATE_FORMAT, pct, split_tokens, try_int
from flagloom.operators import aggregate as agg
from flagloom.operators import clean, dedupe, derive, encode, rank, reshape
from flagloom.sources import io

# The catalog's type labels and flag column names.
MOVIE, TV_SHOW = "Movie", "TV Show"
MOVIE_FLAG, TV_FLAG = "movie", "tv_show"
RATING_DEFAULT = "Not_Found"


@dataclass(frozen=True)
class CatalogSpec:
    """Column names and vocabularies of a raw catalog table."""

    id_col: str = "show_id"
    type_col: str = "type"
    title_col: str = "title"
    director_col: str = "director"
    country_col: str = "country"
    date_col: str = "date_added"
    release_col: str = "release_year"
    rating_col: str = "rating"
    duration_col: str = "duration"
    genre_col: str = "listed_in"
    genre_sep: str = ","
    country_sep: str = ","
    country_map: Mapping[str, str] = field(default_factory=dict)
    genre_vocab: Sequence[str] | None = None
    rating_vocab: Sequence[str] | None = None
    country_vocab: Sequence[str] | None = None
    genre_prefix: str = ""
    rating_prefix: str = ""
    country_prefix: str = ""
    date_format: str = TEXT_DATE_FORMAT


@dataclass
class Encoded:
    """Stage-1 output and the names of the flag columns it created."""

    df: DataFrame
    genre_flags: dict[str, str]     # column -> genre
    rating_flags: dict[str, str]    # column -> rating value
    country_flags: dict[str, str]   # column -> country


def _names(values: Sequence[str], prefix: str, keep_commas: bool = False) -> dict[str, str]:
    return {prefix + safe_name(v, keep_commas=keep_commas): v for v in values}


def dedupe_catalog(raw: DataFrame, spec: CatalogSpec = CatalogSpec(),
                   keys: Sequence[str] | None = None) -> DataFrame:
    """One raw row per (title, release year) or ``keys``: the one with the smallest id."""
    return dedupe.dedupe(raw, list(keys or [spec.title_col, spec.release_col]), [spec.id_col])


def _country_tokens(spec: CatalogSpec):
    """Countries split on the real separator, mapped as whole names, distinct."""
    toks = split_tokens(spec.country_col, spec.country_sep)
    if spec.country_map:
        m = F.create_map(*[F.lit(x) for kv in spec.country_map.items() for x in kv])
        toks = F.transform(toks, lambda t: F.coalesce(F.element_at(m, t), t))
    return F.array_distinct(toks)


def _scalar_features(df: DataFrame, spec: CatalogSpec, movie_null: str | None, tv_null: str | None) -> DataFrame:
    """Duration / seasons, length class, origin, decade and the country class, from 0/1 type columns."""
    s = spec
    movie, tv = F.col(MOVIE_FLAG) == 1, F.col(TV_FLAG) == 1
    df = derive.extract_number(df, s.duration_col, derive.MINUTES_PATTERN, "duration_min", when=movie)
    df = derive.extract_number(df, s.duration_col, derive.SEASONS_PATTERN, "seasons_num", when=tv)
    df = derive.length_class(df, "content_length_category", movie, "duration_min", tv, "seasons_num",
                             movie_null=movie_null, tv_null=tv_null)
    return df.withColumns({
        "content_origin": derive.missing_class(s.director_col),
        "release_decade": derive.decade_label(try_int(s.release_col)),
        "multi_country_production": derive.count_class("country_count"),
    })


def catalog_rows(raw: DataFrame, spec: CatalogSpec = CatalogSpec(), movie_null: str | None = None,
                 tv_null: str | None = None) -> DataFrame:
    """The long form: raw rows with 0/1 type columns, ``countries`` and ``genres``
    as arrays of distinct names (a null cell has none) and every feature."""
    s = spec
    none = F.array().cast("array<string>")
    df = encode.indicator(raw, s.type_col, {MOVIE_FLAG: MOVIE, TV_FLAG: TV_SHOW}).withColumns({
        "countries": F.coalesce(_country_tokens(s), none),
        "genres": F.coalesce(F.array_distinct(split_tokens(s.genre_col, s.genre_sep)), none),
        "rating": F.coalesce(F.col(s.rating_col), F.lit(RATING_DEFAULT)),
    })
    df = df.withColumn("country_count", F.size("countries"))
    return _scalar_features(df, s, movie_null, tv_null)


def encode_catalog(raw: DataFrame, spec: CatalogSpec = CatalogSpec()) -> Encoded:
    """The wide form. Missing values stay null (no sentinel text that would turn
    into a flag of its own); a null cell sets no flag."""
    s = spec
    df = encode.indicator(raw, s.type_col, {MOVIE_FLAG: MOVIE, TV_FLAG: TV_SHOW})

    df = df.withColumn("_countries", _country_tokens(s))

    wanted = {}
    if s.genre_vocab is None:
        wanted["genre"] = (s.genre_col, s.genre_sep)
    if s.rating_vocab is None:
        wanted["rating"] = (s.rating_col, None)
    if s.country_vocab is None:
        wanted["country"] = ("_countries", None)
    found = encode.vocabulary_lists(df, wanted) if wanted else {}
    genre_vocab = list(s.genre_vocab) if s.genre_vocab is not None else found["genre"]
    rating_vocab = list(s.rating_vocab) if s.rating_vocab is not None else found["rating"]
    country_vocab = list(s.country_vocab) if s.country_vocab is not None else found["country"]

    genres = _names(genre_vocab, s.genre_prefix)
    ratings = _names(rating_vocab, s.rating_prefix, keep_commas=True)
    countries = _names(country_vocab, s.country_prefix, keep_commas=True)
    df = encode.multi_hot(df, s.genre_col, genre_vocab, sep=s.genre_sep,
                          names={v: n for n, v in genres.items()})
    df = encode.one_hot(df, s.rating_col, vocab=rating_vocab, as_type="boolean",
                        names={v: n for n, v in ratings.items()})
    df = encode.multi_hot(df, "_countries", country_vocab, as_type="int",
                          names={v: n for n, v in countries.items()})
    df = df.drop(s.type_col, s.rating_col, s.country_col, s.genre_col, "_countries")
    return Encoded(df, genres, ratings, countries)


FEATURE_COLUMNS = ["rating", "duration_min", "seasons_num", "content_length_category",
                   "content_origin", "release_decade", "country_count", "multi_country_production"]


def feature_catalog(enc: Encoded, spec: CatalogSpec = CatalogSpec(), movie_null: str | None = None,
                    tv_null: str | None = None) -> DataFrame:
    """Flags as 0/1, the rating label rebuilt from its flags, and the features; row by row."""
    df = clean.bool_to_int(enc.df, [*enc.genre_flags, *enc.rating_flags])
    df = encode.decode_one_hot(df, enc.rating_flags, "rating", default=RATING_DEFAULT)
    df = encode.row_flag_count(df, list(enc.country_flags), "country_count")
    return _scalar_features(df, spec, movie_null, tv_null)


def model_input(feat: DataFrame, feature_cols: Sequence[str], spec: CatalogSpec = CatalogSpec(),
                default_year: int = 2000, out: str = "features") -> DataFrame:
    """Stage 3: parse the added date (default year when unreadable), safe-cast
    the release year, zero-fill the numeric features (defaults are applied
    only here, not written back into the catalog), assemble the vector."""
    from flagloom.operators import ml

    s = spec
    df = feat.withColumns({
        "year_added": derive.year_with_default(s.date_col, s.date_format, default_year),
        s.release_col: F.coalesce(try_int(s.release_col), F.lit(default_year)),
    })
    df = clean.fill_zero(df, list(feature_cols))
    return ml.assemble(df, list(feature_cols), out)


def write_stage(df: DataFrame, path: str, max_records_per_file: int | None = 5_000_000) -> DataFrame:
    """Persist a stage as Parquet and continue from the written copy (cuts
    lineage; a lost executor re-reads files instead of recomputing stages)."""
    io.write_table(df, path, max_records_per_file=max_records_per_file)
    return io.read_table(df.sparkSession, path)


# -- reports -------------------------------------------------------------------

def top_genre_per_country(rows: DataFrame, n: int = 1) -> DataFrame:
    """(country, genre, count) of the most frequent genre(s) per country, from the long form."""
    pairs = reshape.cooccurrence_arrays(rows, "countries", "genres", "country", "genre")
    counts = agg.count_by(pairs, ["country", "genre"], "count")
    return rank.top_n_per_group(counts, ["country"], ["-count", "genre"], n)


def type_share_by_country(rows: DataFrame, digits: int = 1) -> DataFrame:
    """Movies / TV shows of every country and their percentages (null where it has neither)."""
    each = rows.select(F.explode("countries").alias("country"), MOVIE_FLAG, TV_FLAG)
    out = agg.group_sums(each, ["country"], {"movie_count": MOVIE_FLAG, "tvshow_count": TV_FLAG})
    both = F.col("movie_count") + F.col("tvshow_count")
    return out.withColumns({"movie_percentage": pct(F.col("movie_count"), both, digits),
                            "tvshow_percentage": pct(F.col("tvshow_count"), both, digits)})


def rating_share(rows: DataFrame, digits: int = 3) -> DataFrame:
    return agg.share_of_total(rows, ["rating"], "count", "percentage", digits)
