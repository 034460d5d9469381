"""Encoding operators: categorical and delimited columns <-> flag columns.

Flags are added in ONE projection (``withColumns``), never a ``withColumn``
loop, so the analyzer runs once however wide the vocabulary is. Only the wide
forms need a vocabulary on the driver (it becomes the schema); counting and
ranking work on the long form, where a vocabulary stays a DataFrame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagloom.functions.names import check_unique_names, safe_name
from flagloom.functions.scalars import as_flag_int, first_token, split_tokens


def _cast_flag(c: Column, as_type: str) -> Column:
    return c if as_type == "boolean" else c.cast("int")


def indicator(df: DataFrame, col: str, outputs: Mapping[str, str]) -> DataFrame:
    """0/1 columns ``out = (col == value)``; null input gives 0."""
    return df.withColumns({
        out: F.when(F.col(col) == F.lit(value), F.lit(1)).otherwise(F.lit(0))
        for out, value in outputs.items()
    })


def _flag_names(df: DataFrame, vocab: Sequence[str], names: Mapping[str, str] | None,
                prefix: str, keep_commas: bool, replace: Sequence[str] = ()) -> list[str]:
    out = [(names or {}).get(v) or prefix + safe_name(v, keep_commas=keep_commas) for v in vocab]
    existing = [c for c in df.columns if c not in replace]
    return check_unique_names(out, existing)


def multi_hot(df: DataFrame, col: str, vocab: Sequence[str], sep: str = ",", trim: bool = True,
              as_type: str = "boolean", names: Mapping[str, str] | None = None,
              prefix: str = "", drop_source: bool = False) -> DataFrame:
    """One flag per vocabulary term: does the delimited cell contain it?

    Elements are trimmed (``trim=False`` keeps the leading spaces a plain
    ``split(',')`` leaves). An ``array<string>`` column is used as is. A null
    cell holds no terms, so all its flags are false / 0.
    """
    if dict(df.dtypes)[col].startswith("array"):
        base, tokens = df, F.col(col)
    else:
        # tokenise once per row into a helper column; every flag then tests
        # membership in that array (the optimizer does not inline a non-cheap
        # expression into many uses, so the split runs once, not once per flag)
        toks = split_tokens(col, sep, trim=trim) if trim else F.split(F.col(col), sep)
        base, tokens = df.withColumn("_tokens", toks), F.col("_tokens")
    flag_names = _flag_names(df, vocab, names, prefix, keep_commas=False)
    flags = {n: _cast_flag(F.coalesce(F.array_contains(tokens, F.lit(v)), F.lit(False)), as_type)
             for n, v in zip(flag_names, vocab)}
    out = base.withColumns(flags).drop("_tokens")
    return out.drop(col) if drop_source else out


def vocabulary(df: DataFrame, col: str, sep: str | None = None, trim: bool = True,
               value: str = "value", count: str = "n") -> DataFrame:
    """Distinct values (or delimited terms) of ``col`` with their row counts.

    A delimited cell counts each distinct term once. The count is a
    distributed partial + final aggregate, so a hot value costs one row per
    map task in the shuffle.
    """
    if sep is None:
        v = F.col(col)
    else:
        v = F.explode(F.array_distinct(split_tokens(col, sep, trim=trim)))
    return (df.select(v.alias(value)).where(F.col(value).isNotNull())
              .groupBy(value).agg(F.count(F.lit(1)).alias(count)))


def vocabulary_list(df: DataFrame, col: str, sep: str | None = None, trim: bool = True) -> list[str]:
    """Sorted distinct values of a column that is a dictionary by definition.

    They become column names, so they come to the driver. A column of unknown
    size stays a DataFrame: use :func:`vocabulary`.
    """
    return sorted(r[0] for r in vocabulary(df, col, sep, trim).select("value").collect())


def vocabulary_lists(df: DataFrame, sources: Mapping[str, tuple[str, str | None]],
                     trim: bool = True) -> dict[str, list[str]]:
    """Several dictionaries in ONE scan: ``{name: (column, sep or None)}``
    (``sep=None`` for a single-valued column; array columns are used as is).

    Values of all columns are tagged with their source and de-duplicated in one
    aggregate (each map task combines its own first).
    """
    def tag(name: str):
        return lambda v: F.struct(F.lit(name).alias("src"), v.alias("value"))

    types = dict(df.dtypes)
    arrays = []
    for name, (col, sep) in sources.items():
        if types[col].startswith("array"):
            vals = F.array_distinct(F.col(col))
        elif sep is None:
            vals = F.array(F.col(col))
        else:
            vals = F.array_distinct(split_tokens(col, sep, trim=trim))
        # a null cell must not null the whole concatenation (and the row's other values)
        vals = F.coalesce(vals, F.array().cast("array<string>"))
        arrays.append(F.transform(vals, tag(name)))
    tagged = df.select(F.explode(F.concat(*arrays)).alias("x")).select("x.*")
    out: dict[str, list[str]] = {name: [] for name in sources}
    for r in tagged.where(F.col("value").isNotNull()).distinct().collect():
        out[r["src"]].append(r["value"])
    return {name: sorted(vals) for name, vals in out.items()}


def one_hot(df: DataFrame, col: str, vocab: Sequence[str] | None = None, as_type: str = "boolean",
            prefix: str = "", keep_commas: bool = True,
            names: Mapping[str, str] | None = None, drop_source: bool = False) -> DataFrame:
    """One flag per distinct value of a single-valued column.

    ``vocab=None`` discovers the values (sorted, so the column order is
    deterministic). A null cell sets no flag.
    """
    if vocab is None:
        vocab = vocabulary_list(df, col)
    flag_names = _flag_names(df, vocab, names, prefix, keep_commas=keep_commas)
    c = F.col(col)
    flags = {n: _cast_flag(F.coalesce(c == F.lit(v), F.lit(False)), as_type)
             for n, v in zip(flag_names, vocab)}
    out = df.withColumns(flags)
    return out.drop(col) if drop_source else out


def canonicalize(df: DataFrame, col: str, sep: str = ",", mapping: Mapping[str, str] | None = None,
                 out: str | None = None) -> DataFrame:
    """First token of a delimited cell, then whole-value mapping.

    Splitting on the real separator keeps multi-word names whole
    ("United Kingdom"); the mapping then rewrites complete values only.
    """
    v = first_token(col, sep)
    if mapping:
        m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        v = F.coalesce(F.element_at(m, v), v) if len(mapping) else v
    return df.withColumn(out or col, v)


def decode_one_hot(df: DataFrame, flags: Mapping[str, str], out: str, default: str | None = None) -> DataFrame:
    """Flags back to one label: the first set flag in ``flags`` order wins."""
    types = dict(df.dtypes)
    branches = [F.when(as_flag_int(F.col(f), types[f]) == 1, F.lit(label)) for f, label in flags.items()]
    return df.withColumn(out, F.coalesce(*branches, F.lit(default)))


def row_flag_count(df: DataFrame, cols: Sequence[str], out: str, null_as_zero: bool = True) -> DataFrame:
    """Row-wise number of set flags (0 for no flags at all), in one array
    expression however many there are.

    ``null_as_zero=False`` makes the count null when any flag is null.
    """
    if not cols:
        return df.withColumn(out, F.lit(0))
    types = dict(df.dtypes)
    flags = F.array(*[as_flag_int(F.col(c), types[c]) for c in cols])
    n = F.size(F.filter(flags, lambda v: v == 1))
    return df.withColumn(out, n if null_as_zero else F.when(~F.exists(flags, lambda v: v.isNull()), n))
