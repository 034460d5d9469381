"""Scalar column helpers.

All of them are ANSI-safe: malformed input gives null instead of failing the
job (``try_cast``, ``try_to_date``, ``get``, ``try_divide``), so no operator
ever needs to flip ``spark.sql.ansi.enabled``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the long-form text date layout of the catalog ("August 4, 2017").
TEXT_DATE_FORMAT = "MMMM d, yyyy"

# Text that can possibly cast to an integer: optional sign and digits, padded
# by the characters Spark's cast trims (control characters, space, DEL).
INT_TEXT = r"^[\x00-\x20\x7f]*[+-]?[0-9]+[\x00-\x20\x7f]*$"
INTEGRAL_TYPES = ("tinyint", "smallint", "int", "integer", "bigint", "long", "byte", "short")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_tokens(c: Column | str, sep: str = ",", trim: bool = True) -> Column:
    """``split`` on a literal separator, each element trimmed (empty cells -> [])."""
    parts = F.split(_c(c), _regex_literal(sep))
    if trim:
        parts = F.transform(parts, lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def _regex_literal(sep: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in sep)


def first_token(c: Column | str, sep: str = " ") -> Column:
    """First element of ``split(c, sep)``, trimmed; null when there is none."""
    return F.trim(F.get(F.split(_c(c), _regex_literal(sep)), 0))


def try_int(c: Column | str, to: str = "int") -> Column:
    """``try_cast(c as to)`` for text, without its slow path.

    A failing ``try_cast`` from text costs ~10x a successful one, which
    dominates a scan where most values are not numbers. Only text that can
    possibly be an integer reaches the cast (it still turns overflow into
    null); everything else is null straight away. Same results as
    ``try_cast`` (checked in tests), far cheaper on non-numbers.
    """
    c = _c(c)
    return F.when(c.rlike(INT_TEXT), c.try_cast(to))


def extract_int(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group as int; a miss (``''``) or overflow gives null, never an error."""
    return try_int(F.regexp_extract(_c(c), pattern, group))


def parse_text_date(c: Column | str, fmt: str = TEXT_DATE_FORMAT) -> Column:
    """Trimmed text -> date; unparseable text gives null."""
    return F.try_to_date(F.trim(_c(c)), fmt)


def year_of_text(c: Column | str, fmt: str = TEXT_DATE_FORMAT, default: int | None = None) -> Column:
    y = F.year(parse_text_date(c, fmt))
    return y if default is None else F.coalesce(y, F.lit(default))


def pct(part: Column | str, whole: Column | str, digits: int = 1) -> Column:
    """``round(part / whole * 100, digits)``; a zero or null whole gives null."""
    return F.round(F.try_divide(_c(part).cast("double"), _c(whole)) * F.lit(100.0), digits)


def format_pct(c: Column | str, digits: int = 1) -> Column:
    """``12.3%`` text of an already rounded value (round first, then format)."""
    return F.format_string(f"%.{digits}f%%", F.round(_c(c), digits))


def format_thousands(c: Column | str) -> Column:
    """``1,234`` text of an integer value."""
    return F.format_number(_c(c).cast("long"), 0)


def capitalize(c: Column | str) -> Column:
    """Python ``str.capitalize`` semantics: first letter upper, rest lower."""
    c = _c(c)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def as_flag_int(c: Column | str, dtype: str) -> Column:
    """Map a flag of any storage type to 1 / 0 / null.

    booleans cast directly; numbers keep their integer value; text maps
    'true'/'false' (trimmed, any case) to 1/0 and otherwise tries an int cast.
    """
    c = _c(c)
    if dtype == "boolean":
        return c.cast("int")
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return c.try_cast("int")
    s = F.lower(F.trim(c.cast("string")))
    return (F.when(s == "true", F.lit(1))
             .when(s == "false", F.lit(0))
             .otherwise(try_int(s)))
