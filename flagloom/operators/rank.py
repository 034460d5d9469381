"""Sorting, top-k and per-group ranking.

Every rank carries explicit tie-break columns so results are deterministic.
``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject`` (a per-partition
top-k, never a full sort), and a ``row_number() <= n`` filter next to its
window becomes a ``WindowGroupLimit`` that drops rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flagloom.operators.reshape import unpivot


def _order(spec: str | Column) -> Column:
    """'-name' sorts descending; nulls go last either way."""
    if isinstance(spec, Column):
        return spec
    if spec.startswith("-"):
        return F.col(spec[1:]).desc_nulls_last()
    return F.col(spec).asc_nulls_last()


def sort_by(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*[_order(o) for o in order])


def top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    """The first ``k`` rows in ``order`` (a total order: add tie-break columns)."""
    return df.orderBy(*[_order(o) for o in order]).limit(k)


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1,
                    rank_col: str | None = None, salt_buckets: int | None = None) -> DataFrame:
    """Rows ranked 1..n inside each group of ``keys`` (row_number, so no ties).

    Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) Spark plans
    a map-side group limit, so a hot group never reaches one task whole. For a
    larger n over hot groups pass ``salt_buckets``, say a few times the
    cluster's cores: the ranking then runs in two phases, first inside
    (keys, salt), keeping n rows per bucket, then inside keys; a hot group's
    last task sees at most n x buckets rows. ``order`` must be a total
    order (add tie-break columns) for the two phases to agree.
    """
    spec = [_order(o) for o in order]
    rc = rank_col or "_rank"
    if salt_buckets:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
        df = df.withColumn("_salt", salt)
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*spec)
        df = df.withColumn(rc, F.row_number().over(w1)).where(F.col(rc) <= n).drop("_salt", rc)
    w = Window.partitionBy(*keys).orderBy(*spec)
    out = df.withColumn(rc, F.row_number().over(w)).where(F.col(rc) <= n)
    return out if rank_col else out.drop(rc)


def top_n_measures(df: DataFrame, ids: Sequence[str], measures: Sequence[str], n: int = 3,
                   key: str = "feature", value: str = "value", joined: str | None = None,
                   sep: str = ", ", strip_prefix: str = "") -> DataFrame:
    """The ``n`` largest measures of each row of a wide summary.

    Long output: (ids..., rank, key, value). With ``joined`` the names are
    folded into one ordered text column per id instead.
    """
    long = unpivot(df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures]),
                   ids, measures, key, value)
    if strip_prefix:
        long = long.withColumn(key, F.regexp_replace(F.col(key), "^" + strip_prefix, ""))
    if not joined:
        return top_n_per_group(long.where(F.col(value).isNotNull()), ids, [f"-{value}", key], n,
                               rank_col="rank")
    # joined form keeps every id, even one whose measures are all null
    ranked = top_n_per_group(long, ids, [f"-{value}", key], n, rank_col="rank")
    kept = F.when(F.col(value).isNotNull(), F.struct("rank", key))
    ordered = F.array_sort(F.collect_list(kept))
    return ranked.groupBy(*ids).agg(
        F.array_join(F.transform(ordered, lambda s: s[key]), sep).alias(joined))
