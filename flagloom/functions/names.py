"""Turning data values into safe column names.

Flag columns are named after the values they encode, so a value such as
``Sci-Fi & Fantasy`` must become a legal, stable identifier. The same rule is
offered twice: ``safe_name`` for driver-side names (vocabularies are small and
bounded) and ``safe_name_col`` as a column expression for tables of values.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the naming rule (they decide the flag column names):
#   trim spaces at both ends; "&" becomes "and"; space, "-" and "/" become "_";
#   "." and "'" are removed; "," is removed too unless keep_commas=True.
AMPERSAND_WORD = "and"
UNDERSCORE_CHARS = " -/"
DROPPED_CHARS = ".'"
COMMA = ","


def _dropped(keep_commas: bool) -> str:
    return DROPPED_CHARS if keep_commas else DROPPED_CHARS + COMMA


def safe_name(value: str, keep_commas: bool = False) -> str:
    """Driver-side form of the naming rule."""
    s = value.strip(" ").replace("&", AMPERSAND_WORD)  # spaces only, as Spark's trim
    s = re.sub("[" + re.escape(UNDERSCORE_CHARS) + "]", "_", s)
    return re.sub("[" + re.escape(_dropped(keep_commas)) + "]", "", s)


def safe_name_col(c: Column | str, keep_commas: bool = False) -> Column:
    """Column form of :func:`safe_name`; runs inside whole-stage codegen."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.replace(F.trim(c), F.lit("&"), F.lit(AMPERSAND_WORD))
    for chars, to in ((UNDERSCORE_CHARS, "_"), (_dropped(keep_commas), "")):
        s = F.translate(s, chars, to * len(chars))
    return s


def check_unique_names(names: Iterable[str], existing: Iterable[str] = ()) -> list[str]:
    """Raise if two names (or a name and an existing column) differ only by case.

    Spark resolves column names case-insensitively by default, so ``Not_found``
    and ``Not_Found`` would silently overwrite one another.
    """
    seen: dict[str, str] = {n.lower(): n for n in existing}
    out = []
    for n in names:
        k = n.lower()
        if k in seen:
            raise ValueError(f"column name collision: {n!r} vs {seen[k]!r}")
        seen[k] = n
        out.append(n)
    return out
