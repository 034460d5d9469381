"""Distinct rows and de-duplication with a defined survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def dup_report(df: DataFrame, keys: Sequence[str], total: str = "total_rows",
               distinct: str = "distinct_rows", dropped: str = "duplicate_rows") -> DataFrame:
    """Total rows, distinct key tuples and their difference in ONE aggregate.

    ``count_distinct(struct(keys))`` counts a tuple with a null member like
    ``distinct().count()`` does (plain ``count_distinct(a, b)`` skips it).
    """
    key = F.struct(*keys)
    out = df.agg(F.count(F.lit(1)).alias(total), F.count_distinct(key).alias(distinct))
    return out.withColumn(dropped, F.col(total) - F.col(distinct))


def dedupe(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep one row per ``keys``: the first in ``order_by`` ('-col' = descending;
    nulls first ascending, last descending).

    The remaining columns, in their order, break ties, so the survivor is
    defined; columns of types without an order take no part in that. Planned as
    ``row_number() = 1`` with a map-side group limit: a key repeated across a
    third of the table costs one row per task before the shuffle, and columns
    that a later step does not need are not carried as ties of a struct.
    """
    named = [o.removeprefix("-") for o in order_by]
    order = [F.col(c).desc() if o.startswith("-") else F.col(c).asc() for o, c in zip(order_by, named)]
    order += [F.col(c).asc() for c, t in df.dtypes
              if c not in named and c not in keys and not any(x in t for x in ("map<", "variant", "interval"))]
    # a hash of the text keys leads: sorts decide on it before comparing long texts
    texts = [k for k in keys if dict(df.dtypes)[k] == "string"]
    lead = [F.xxhash64(*texts)] if texts else []
    w = Window.partitionBy(*lead, *keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
