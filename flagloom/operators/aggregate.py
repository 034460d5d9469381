"""Aggregations.

All of them are single-pass partial + final aggregates: each map task
combines its rows before the shuffle, so a key holding a third of the data
sends one row per map task, not a third of the table. Totals needed for a
share are scalar subqueries over the already aggregated rows, never a driver
round trip and never a single-partition window over raw rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagloom.functions.scalars import as_flag_int, pct
from flagloom.operators.reshape import unpivot_flags
from flagloom.sources.io import small_table


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Rows per non-null value, most frequent first (value breaks ties)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.col(name).desc(), F.col(col).asc()))


def profile_columns(df: DataFrame, long: bool = True, key: str = "column",
                    value: str = "n_null", with_types: bool = False) -> DataFrame:
    """Null count of every column in one scan; long form (column, n_null).

    ``with_types`` adds each column's position and type from the schema (a
    literal lookup, bounded by the width), so one table answers "what is in
    this table" for names, types and missing values together.
    """
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    if not long:
        return wide
    out = wide.unpivot([], df.columns, key, value)
    if with_types:
        fields = df.schema.fields
        ordinal = F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (f.name, i)])
        dtype = F.create_map(*[F.lit(x) for f in fields for x in (f.name, f.dataType.simpleString())])
        out = out.select(ordinal[F.col(key)].alias("ordinal"), key, dtype[F.col(key)].alias("type"), value)
    return out


def flag_totals(df: DataFrame, flags: Sequence[str], where=None, long: bool = True,
                key: str = "flag", value: str = "total") -> DataFrame:
    """Sum of every flag column (any storage type) in one pass."""
    if where is not None:
        df = df.where(where)
    types = dict(df.dtypes)
    wide = df.agg(*[F.sum(as_flag_int(F.col(f), types[f])).cast("long").alias(f) for f in flags])
    return wide.unpivot([], list(flags), key, value) if long else wide


def group_sums(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """``{out: column}`` sums per group."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(out) for out, c in measures.items()])


def group_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "avg_",
                digits: int | None = None) -> DataFrame:
    """Mean of many columns per group in one pass (booleans averaged as 0/1)."""
    types = dict(df.dtypes)
    aggs = []
    for c in cols:
        v = F.col(c).cast("int") if types[c] == "boolean" else F.col(c)
        a = F.avg(v)
        aggs.append((F.round(a, digits) if digits is not None else a).alias(prefix + c))
    return df.groupBy(*keys).agg(*aggs)


def min_max(df: DataFrame, col: str, lo: str = "min", hi: str = "max") -> DataFrame:
    return df.agg(F.min(col).alias(lo), F.max(col).alias(hi))


def share_of_total(df: DataFrame, keys: Sequence[str], count: str = "count",
                   share: str = "percentage", digits: int = 3) -> DataFrame:
    """Rows per group and their percentage of all rows.

    The total is a scalar subquery over the grouped rows (Spark reuses the
    grouped exchange for it), so nothing is pulled to the driver and no
    window collapses the table into one partition.
    """
    counts = count_by(df, keys, count)
    total = counts.select(F.sum(count)).scalar()
    return counts.withColumn(share, pct(F.col(count), total, digits))


def two_way_pct_by_flag(df: DataFrame, flags: Sequence[str], a: str, b: str, key: str = "key",
                        a_count: str = "a_count", b_count: str = "b_count",
                        a_pct: str = "a_percentage", b_pct: str = "b_percentage",
                        digits: int = 1, labels: Mapping[str, str] | None = None,
                        spark: SparkSession | None = None) -> DataFrame:
    """Per flag: totals of two measures over the rows where the flag is set,
    and each measure's percentage of their sum.

    One scan + one unpivot + one aggregate instead of a filter/aggregate per
    flag glued with unions. Flags that are never set are kept (counts null)
    by a left join from the flag list, which is a parameter-sized table.
    """
    types = dict(df.dtypes)
    base = df.select(as_flag_int(F.col(a), types[a]).alias("_a"),
                     as_flag_int(F.col(b), types[b]).alias("_b"), *flags)
    long = unpivot_flags(base, ["_a", "_b"], flags, key=key, value="_v", labels=labels)
    agg = long.groupBy(key).agg(F.sum("_a").cast("long").alias(a_count),
                                F.sum("_b").cast("long").alias(b_count))
    both = F.col(a_count) + F.col(b_count)
    agg = agg.withColumns({a_pct: pct(F.col(a_count), both, digits),
                           b_pct: pct(F.col(b_count), both, digits)})
    spark = spark or df.sparkSession
    names = [(labels or {}).get(f, f) for f in flags]
    keys = small_table(spark, [(n,) for n in dict.fromkeys(names)], f"`{key}` string")
    # ``agg`` has at most one row per flag (a parameter), so broadcasting it is
    # size-bounded no matter how large ``df`` is.
    return keys.join(F.broadcast(agg), on=key, how="left")
