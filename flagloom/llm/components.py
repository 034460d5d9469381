"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagloom.llm.common import settle


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an undirected link table; ``root`` is
    the smallest node of its component.

    Alternates two rewirings until the links no longer change: every node's
    larger neighbours move to its smallest neighbour, then its smaller ones
    do. Each step is an aggregate and a join on the node, so a hub is split by
    the engine like any skewed key, and each result is written to the shared
    checkpoint folder. Rounds grow with the logarithm of the component size.
    Self-links and null ends are ignored; no links give no rows.
    """
    edges = settle(links.where(F.col(a) != F.col(b))
                   .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = settle(both.where("v > u").join(low, "u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "links")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = settle(edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now or not now[0]:
            break
        before = now
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
