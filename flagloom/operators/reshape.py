"""Reshaping: wide flag columns <-> long (key, value) rows.

``unpivot`` plans as an ``Expand`` node inside the scan's codegen stage, and
the "only set flags" filter sits right after it, so the rows that reach the
next aggregate's partial (map-side) step are only the set ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagloom.functions.scalars import as_flag_int


def _label_col(key: str, labels: Mapping[str, str] | None):
    if not labels:
        return F.col(key)
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(m, F.col(key)), F.col(key))


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], key: str = "key",
            value: str = "value") -> DataFrame:
    """Wide -> long; all ``cols`` must share one type (cast them first)."""
    return df.unpivot(list(ids), list(cols), key, value)


def unpivot_flags(df: DataFrame, ids: Sequence[str], flags: Sequence[str], key: str = "key",
                  value: str = "value", set_only: bool = True,
                  labels: Mapping[str, str] | None = None) -> DataFrame:
    """Unpivot flag columns of any storage type (boolean, 0/1, 'true'/'false').

    Flags are normalised to int first, so mixed boolean/int columns unpivot
    together. ``set_only`` keeps rows whose flag is 1. ``labels`` renames
    keys (column name -> label).
    """
    types = dict(df.dtypes)
    norm = df.select(*ids, *[as_flag_int(F.col(f), types[f]).alias(f) for f in flags])
    long = norm.unpivot(list(ids), list(flags), key, value)
    if set_only:
        long = long.where(F.col(value) == 1)
    if labels:
        long = long.withColumn(key, _label_col(key, labels))
    return long


def cooccurrence(df: DataFrame, left_flags: Sequence[str], right_flags: Sequence[str],
                 left_key: str = "left", right_key: str = "right",
                 left_labels: Mapping[str, str] | None = None,
                 right_labels: Mapping[str, str] | None = None) -> DataFrame:
    """(left label, right label) for every pair of flags set on the same row.

    Two successive unpivots; pairs are only ever formed inside one row, so the
    output per row is bounded by the two vocabulary sizes.
    """
    step = unpivot_flags(df, list(right_flags), left_flags, key=left_key, value="_l", labels=left_labels)
    return unpivot_flags(step.drop("_l"), [left_key], right_flags, key=right_key,
                         value="_r", labels=right_labels).drop("_r")


def cooccurrence_arrays(df: DataFrame, left: str, right: str, left_key: str = "left",
                        right_key: str = "right") -> DataFrame:
    """Same pairs from two array columns (the preferred, long-form source)."""
    return (df.select(F.explode(F.array_distinct(F.col(left))).alias(left_key), right)
              .select(left_key, F.explode(F.array_distinct(F.col(right))).alias(right_key)))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], key: str = "variable",
         value: str = "value") -> DataFrame:
    """Measures per group -> long (id..., key, value)."""
    return df.unpivot(list(ids), list(values), key, value)
