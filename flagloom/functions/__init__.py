"""Column-expression helpers shared by the operators."""

from flagloom.functions.names import check_unique_names, safe_name, safe_name_col
from flagloom.functions.predicates import MISSING_TOKENS, is_missing, norm_text, text_equals
from flagloom.functions.scalars import (
    TEXT_DATE_FORMAT,
    as_flag_int,
    capitalize,
    extract_int,
    first_token,
    format_pct,
    format_thousands,
    parse_text_date,
    pct,
    split_tokens,
    try_int,
    year_of_text,
)

__all__ = [
    "MISSING_TOKENS", "TEXT_DATE_FORMAT", "as_flag_int", "capitalize", "check_unique_names",
    "extract_int", "first_token", "format_pct", "format_thousands", "is_missing", "norm_text",
    "parse_text_date", "pct", "safe_name", "safe_name_col", "split_tokens", "text_equals", "try_int",
    "year_of_text",
]
