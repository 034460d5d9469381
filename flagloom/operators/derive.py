"""Derived features: numbers from text, bins, rule-based classes.

Labels, edges and tokens are parameters; the catalog's own values are the
defaults below. Every branch is explicit, including what a null input gets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagloom.functions.predicates import MISSING_TOKENS, is_missing
from flagloom.functions.scalars import extract_int, year_of_text

# Fixed values of the catalog features (labels and edges).
MINUTES_PATTERN = r"(\d+)\s*min"
SEASONS_PATTERN = r"(\d+)\s*Season"
MOVIE_BINS = ((None, 29, "Short"), (30, 90, "Medium"), (91, None, "Long"))
TV_BINS = ((1, 1, "One_Season"), (2, 3, "Multi_Season"), (4, None, "Long_Running"))
UNKNOWN = "Unknown"
DECADE_FLOOR = 1950
DECADE_OPEN_FROM = 2020
MULTI_LABEL, SINGLE_LABEL = "Multi-Country", "Single-Country"
MISSING_LABEL, PRESENT_LABEL = "Original", "Licensed"
PERIOD_YEAR, BEFORE_LABEL, AFTER_LABEL = 2015, "Before 2015", "After 2015"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_number(df: DataFrame, col: str, pattern: str, out: str, when: Column | None = None) -> DataFrame:
    """Regex-extracted int; null on a miss and, with ``when``, outside it."""
    v = extract_int(col, pattern)
    return df.withColumn(out, F.when(when, v) if when is not None else v)


def range_label(c: Column | str, bins: Sequence[tuple], default: str | None = UNKNOWN,
                null_label: str | None = None) -> Column:
    """Label of the first ``(lo, hi, label)`` bin holding ``c`` (inclusive,
    ``None`` = open). Null input gets ``null_label`` (default: ``default``)."""
    c = _c(c)
    expr = F.when(c.isNull(), F.lit(null_label if null_label is not None else default))
    for lo, hi, label in bins:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (c >= lo)
        if hi is not None:
            cond = cond & (c <= hi)
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def length_class(df: DataFrame, out: str, movie_flag: Column, minutes: Column | str,
                 tv_flag: Column, seasons: Column | str, movie_bins=MOVIE_BINS, tv_bins=TV_BINS,
                 movie_null: str | None = None, tv_null: str | None = None,
                 default: str = UNKNOWN) -> DataFrame:
    """Two-level class: bins of ``minutes`` for movies, of ``seasons`` for TV.

    ``movie_null`` / ``tv_null`` say what an unreadable value gets; by default
    it falls in the last (open) bin, which is what the catalog did.
    """
    last_m, last_t = movie_bins[-1][2], tv_bins[-1][2]
    m = range_label(minutes, movie_bins, default=last_m, null_label=movie_null or last_m)
    t = range_label(seasons, tv_bins, default=last_t, null_label=tv_null or last_t)
    return df.withColumn(out, F.when(movie_flag, m).when(tv_flag, t).otherwise(F.lit(default)))


def decade_label(c: Column | str, floor: int = DECADE_FLOOR, open_from: int = DECADE_OPEN_FROM,
                 unknown: str = UNKNOWN) -> Column:
    """'1990s' style label; years before ``floor`` and null are ``unknown``;
    everything from ``open_from`` on shares the last label."""
    c = _c(c)
    decade = F.concat((F.floor(c / 10) * 10).cast("int").cast("string"), F.lit("s"))
    return (F.when(c >= open_from, F.lit(f"{open_from}s"))
             .when(c >= floor, decade)
             .otherwise(F.lit(unknown)))


def period_label(c: Column | str, year: int = PERIOD_YEAR, before: str = BEFORE_LABEL,
                 after: str = AFTER_LABEL) -> Column:
    """``before`` for years < ``year``; everything else (equal year, null) is ``after``."""
    return F.when(_c(c) < year, F.lit(before)).otherwise(F.lit(after))


def missing_class(c: Column | str, missing: str = MISSING_LABEL, present: str = PRESENT_LABEL,
                  tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    return F.when(is_missing(c, tokens), F.lit(missing)).otherwise(F.lit(present))


def count_class(n: Column | str, multi: str = MULTI_LABEL, single: str = SINGLE_LABEL,
                unknown: str = UNKNOWN) -> Column:
    n = _c(n)
    return F.when(n > 1, F.lit(multi)).when(n == 1, F.lit(single)).otherwise(F.lit(unknown))


def year_with_default(c: Column | str, fmt: str, default: int) -> Column:
    """Year of a text date; unparseable text gets ``default``."""
    return year_of_text(c, fmt, default)


def label_from_flag(c: Column | str) -> Column:
    """Class label (double) from a 0/1 flag."""
    return _c(c).cast("double")
