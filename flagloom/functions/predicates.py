"""Reusable predicate expressions (all ANSI-safe, all codegen-able)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings that count as "missing" text (compared after
# trim + lower-case). The empty string covers blank cells.
MISSING_TOKENS = ("", "not found", "not_found", "n/a")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_text(c: Column | str) -> Column:
    """``lower(trim(cast(c as string)))``; the canonical form used for tests."""
    return F.lower(F.trim(_c(c).cast("string")))


def text_equals(c: Column | str, value: str) -> Column:
    """Case-blind, trimmed string equality."""
    return norm_text(c) == F.lit(value.strip().lower())


def is_missing(c: Column | str, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """True when ``c`` is null or holds one of the missing-value tokens."""
    return _c(c).isNull() | norm_text(c).isin([t.strip().lower() for t in tokens])


