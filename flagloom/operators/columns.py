"""Column management: selection by list or pattern, bulk add, drop, rename."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The requested names that exist, in request order, deduplicated."""
    have = set(df.columns)
    return [c for c in dict.fromkeys(wanted) if c in have]


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Select only the requested columns that exist (missing ones are skipped)."""
    return df.select(*present(df, wanted))


def matching(df: DataFrame, include_regex: str, exclude_prefixes: Sequence[str] = (),
             min_length: int = 0) -> list[str]:
    rx = re.compile(include_regex)
    return [c for c in df.columns
            if rx.search(c) and len(c) >= min_length and not c.startswith(tuple(exclude_prefixes))]


def select_matching(df: DataFrame, include_regex: str, exclude_prefixes: Sequence[str] = (),
                    min_length: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Select ``keep`` plus every column whose name matches the pattern."""
    cols = list(keep) + [c for c in matching(df, include_regex, exclude_prefixes, min_length) if c not in keep]
    return df.select(*cols)


def add_columns(df: DataFrame, exprs: Mapping[str, Column | str]) -> DataFrame:
    """Add or replace many columns in ONE projection (strings are SQL text)."""
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in exprs.items()})


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; names that are not there are ignored."""
    return df.drop(*cols)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))
