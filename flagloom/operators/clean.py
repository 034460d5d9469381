"""Missing values, value mapping, boolean-ish text and casts.

All operators are ANSI-safe (malformed values become null through
``try_cast``), so results do not depend on ``spark.sql.ansi.enabled``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagloom.functions.predicates import norm_text
from flagloom.functions.scalars import INTEGRAL_TYPES, as_flag_int, capitalize, try_int

# Fixed value: the token written into missing text cells by the catalog clean-up.
NOT_FOUND = "Not found"


def fill_strings(df: DataFrame, token: str = NOT_FOUND, subset: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls of string columns only (other types are left alone)."""
    return df.fillna(token, subset=list(subset) if subset else None)


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Per-column fill values."""
    return df.fillna(dict(values))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls -> 0 on ``cols``; boolean columns are cast to int first.

    (``fillna(0)`` alone silently skips boolean columns.)
    """
    types = dict(df.dtypes)
    casted = {c: F.col(c).cast("int") for c in cols if types.get(c) == "boolean"}
    if casted:
        df = df.withColumns(casted)
    return df.fillna(0, subset=[c for c in cols if c in types])


def replace_values(df: DataFrame, mapping: Mapping[str, str | None], subset: Sequence[str] | None = None) -> DataFrame:
    """Whole-value replacement on string columns (all of them when no subset).

    A value mapped to ``None`` becomes null."""
    types = dict(df.dtypes)
    cols = [c for c in (subset or df.columns) if types.get(c) == "string"]
    if not cols or not mapping:
        return df
    m = F.create_map(*[F.lit(x).cast("string") for kv in mapping.items() for x in kv])
    return df.withColumns({c: F.when(F.map_contains_key(m, F.col(c)), F.element_at(m, F.col(c))).otherwise(F.col(c))
                           for c in cols})


def map_values_table(df: DataFrame, col: str, mapping: DataFrame, key: str, value: str,
                     out: str | None = None) -> DataFrame:
    """Value mapping from a table (for maps too large to inline as literals).

    A plain left join: the engine broadcasts the mapping if its bytes are under
    the session's threshold, else shuffles, where a hot value's partition is
    split at run time. A duplicated key maps to its smallest value; a key that
    maps to null, or is not in the table, leaves the value as it is.
    """
    m = mapping.groupBy(F.col(key).alias("_mk")).agg(F.min(value).alias("_mv"))
    joined = df.join(m, F.col(col) == F.col("_mk"), "left")
    return joined.withColumn(out or col, F.coalesce(F.col("_mv"), F.col(col))).drop("_mk", "_mv")


def bool_to_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """'true'/'false' (any case, padded) -> 1/0; anything else -> int or null."""
    types = dict(df.dtypes)
    return df.withColumns({c: as_flag_int(F.col(c), types[c]) for c in cols if c in types})


def boolean_like_columns(df: DataFrame, key: str = "column", value: str = "is_boolean_like") -> DataFrame:
    """(column, is_boolean_like) for every column, in one scan.

    Typed boolean columns are boolean-like without reading data; a string
    column is when any of its values is 'true' or 'false' after trim and
    lower-casing. All string columns are tested in a single aggregate.
    """
    types = df.dtypes
    string_cols = [c for c, t in types if t == "string"]
    flags = {c: F.lit(True) for c, t in types if t == "boolean"}
    if string_cols:
        probe = df.agg(*[F.coalesce(F.bool_or(norm_text(F.col(c)).isin("true", "false")), F.lit(False)).alias(c)
                         for c in string_cols])
    else:
        probe = df.sparkSession.range(1).select()
    wide = probe.select(*[flags.get(c, F.col(c) if c in string_cols else F.lit(False)).alias(c)
                          for c, _ in types])
    return wide.unpivot([], [c for c, _ in types], key, value)


def convert_boolean_like(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Detect boolean-like columns (one scan) and convert exactly those to
    0/1 ints; returns the converted frame and the converted column names.

    Only the per-column yes/no answers reach the driver (bounded by the
    width); the conversion itself is one projection.
    """
    found = [r[0] for r in boolean_like_columns(df, "c", "b").where("b").select("c").collect()]
    return bool_to_int(df, found), found


def cast_columns(df: DataFrame, types: Mapping[str, str], safe: bool = True) -> DataFrame:
    """Cast many columns in one projection; ``safe`` turns failures into null
    (text -> integer goes through the cheap ``try_int`` guard)."""
    src = dict(df.dtypes)

    def one(c: str, t: str):
        if not safe:
            return F.col(c).cast(t)
        if src.get(c) == "string" and t.lower() in INTEGRAL_TYPES:
            return try_int(c, t)
        return F.col(c).try_cast(t)

    return df.withColumns({c: one(c, t) for c, t in types.items()})


def normalize_values(df: DataFrame, col: str, out: str = "name") -> DataFrame:
    """Distinct capitalised, trimmed values (case-blind de-duplication)."""
    return df.select(capitalize(F.trim(F.col(col))).alias(out)).where(F.col(out).isNotNull()).distinct()


def normalize_report(df: DataFrame, col: str, raw: str = "raw_count", unique: str = "unique_count") -> DataFrame:
    """Raw non-null values and distinct capitalised values, one aggregate."""
    v = F.col(col)
    return df.agg(F.count(v).alias(raw), F.count_distinct(capitalize(F.trim(v))).alias(unique))
