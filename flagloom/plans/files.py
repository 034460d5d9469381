"""Queries on files and layouts: listings, sizes, rewritten partitions, pruned scans,
footers, bad rows, and sparse features with the files they travel in."""

from __future__ import annotations

from pyspark.sql import functions as F

from flagloom.functions.scalars import split_tokens
from flagloom.operators import aggregate as agg
from flagloom.operators import ml
from flagloom.plans.catalog import FIT_ROWS, SEED, query, table
from flagloom.session import scratch_path
from flagloom.sources import io


@query("sink_manifest_empty", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_empty, true AS sizes_known FROM orders
""")
def sink_manifest_empty(spark, sf_dir):
    """A listing by file (SNK-3): the orders in folders by status, and a file that a
    day without orders left behind. It holds no row, and it is listed."""
    orders = table(spark, sf_dir, "orders")
    path = io.write_table(orders, scratch_path(spark, "listing"), partition_by=["o_orderstatus"])
    none = orders.where("o_totalprice < 0").drop("o_orderstatus").coalesce(1)
    io.write_table(none, f"{path}/o_orderstatus=none")
    files = io.sink_manifest(spark, path)
    return files.agg(F.sum("rows").alias("n_rows"), F.count_if(F.col("rows") == 0).alias("n_empty"),
                     F.bool_and(F.col("file_size") > 0).alias("sizes_known"))


@query("sink_by_size", "SELECT o_orderstatus, count(*) AS n_rows, true AS even FROM orders GROUP BY 1")
def sink_by_size(spark, sf_dir):
    """Files dealt by size in folders of very different sizes (SNK-2): the rows of
    each folder, and whether its files differ by a factor of two at most (a folder
    of less than two files' worth of rows has one)."""
    orders = table(spark, sf_dir, "orders")
    path = io.write_table(orders, scratch_path(spark, "sized"), partition_by=["o_orderstatus"], target_bytes=256 << 10)
    files = io.sink_manifest(spark, path)
    status = F.regexp_extract("file_path", "/o_orderstatus=([^/]+)/", 1).alias("o_orderstatus")
    return files.groupBy(status).agg(F.sum("rows").alias("n_rows"),
                                     (F.max("rows") <= 2 * F.min("rows")).alias("even"))


@query("partition_rewrite", """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
""")
def partition_rewrite(spark, sf_dir):
    """One status corrected and written again over the whole set (SNK-1): its folder
    is replaced, the others stay."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = io.write_table(orders, scratch_path(spark, "rewrite"), partition_by=["o_orderstatus"])
    later = orders.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    io.write_table(later, path, mode="overwrite_partitions", partition_by=["o_orderstatus"])
    return io.read_table(spark, path, schema="o_orderkey long, o_totalprice double, o_orderstatus string").select(
        "o_orderkey", "o_orderstatus", "o_totalprice")


def clustered_orders(spark, sf_dir):
    """The orders in folders by status, files and row groups by customer, with a
    bloom filter on the order key."""
    return io.write_clustered(table(spark, sf_dir, "orders"), scratch_path(spark, "clustered"), ["o_custkey"],
                              ["o_orderstatus"], bloom={"o_orderkey": 100_000}, row_group_bytes=16 << 20)


@query("pruned_scan", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_custkey BETWEEN 100 AND 200
""")
def pruned_scan(spark, sf_dir):
    """Equality and range filters (FLT-1, FLT-2) on a table laid out for them."""
    orders = io.read_table(spark, clustered_orders(spark, sf_dir))
    return orders.where("o_orderstatus = 'F' AND o_custkey BETWEEN 100 AND 200").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("footer_facts", """
SELECT count(*) AS rows, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey,
       max(o_totalprice) AS max_o_totalprice FROM orders
""")
def footer_facts(spark, sf_dir):
    """Row count, least and greatest values (AGG-1, AGG-8) from the files' footers."""
    return io.footer_facts(spark, f"{sf_dir}/orders.parquet", ["o_orderkey"], ["o_orderkey", "o_totalprice"])


RAGGED_SCHEMA = "o_orderkey long, o_custkey long, o_totalprice double"


def ragged_orders(spark, sf_dir):
    """CSV lines of the orders: one in seven lacks a field, one in eleven has one too
    many, one in thirteen a price that is no number."""
    key = F.col("o_orderkey")
    price = F.when(key % 13 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", key.cast("string"), F.col("o_custkey").cast("string"),
                       F.when(key % 7 != 0, price), F.when(key % 11 == 0, F.lit("x")))
    path = scratch_path(spark, "ragged")
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return path


@query("bad_rows", """
WITH m AS (SELECT o_orderkey % 13 = 0 AND o_orderkey % 7 <> 0 AS text, o_orderkey % 7 = 0 AS short,
                  o_orderkey % 11 = 0 AS long, o_totalprice FROM orders),
k AS (SELECT *, text OR short OR long AS bad FROM m)
SELECT CASE WHEN bad THEN 'bad' ELSE 'good' END AS side, count(*) AS n_rows,
       CASE WHEN bad THEN NULL ELSE CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) END AS cents FROM k GROUP BY bad
""")
def bad_rows(spark, sf_dir):
    """Ragged and unreadable CSV rows set apart from the good ones (SRC-1)."""
    raw = io.read_table(spark, ragged_orders(spark, sf_dir), fmt="csv", schema=RAGGED_SCHEMA, header=False,
                        corrupt_column="_line")
    good, bad = io.split_bad_rows(raw, "_line", scratch_path(spark, "split"))
    return (good.agg(F.lit("good").alias("side"), F.count("*").alias("n_rows"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
            .unionByName(bad.agg(F.lit("bad").alias("side"), F.count("*").alias("n_rows"), F.lit(None).cast("long").alias("cents"))))


def _part_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", split_tokens("p_name", " ").alias("names"),
                                               F.array("p_brand").alias("brands"), "p_size", "p_retailprice")


_SOURCES = {"brand": "brands", "name": "names"}


def _part_vectors(spark, sf_dir):
    parts = _part_tokens(spark, sf_dir)
    words = ml.token_dictionary(parts, _SOURCES, scratch_path(spark, "dictionary"))
    path = scratch_path(spark, "sparse")
    return parts, ml.sparse_features(parts, "p_partkey", _SOURCES, words, path), path


@query("sparse_features", """
WITH t AS (SELECT p_partkey, 'brand' AS source, p_brand AS token FROM part
           UNION ALL SELECT p_partkey, 'name', unnest(string_split(p_name, ' ')) FROM part),
d AS (SELECT source, token, row_number() OVER (ORDER BY source, encode(token)) - 1 AS i FROM (SELECT DISTINCT source, token FROM t))
SELECT DISTINCT p_partkey, CAST(i AS INTEGER) AS index, 1.0::DOUBLE AS value FROM t JOIN d USING (source, token)
""")
def sparse_features(spark, sf_dir):
    """Flags of every brand and tag in one sparse vector, without a column each
    (ENC-2 to ENC-4 with ML-1), as (index, value) pairs."""
    _, _, path = _part_vectors(spark, sf_dir)
    return ml.sparse_pairs(spark, path, "p_partkey")


@query("sparse_clusters", "SELECT count(*) AS n_rows, true AS ids_in_range FROM part")
def sparse_clusters(spark, sf_dir):
    """KMeans (k=4) over sparse flags and numeric columns in one vector."""
    parts, vectors, _ = _part_vectors(spark, sf_dir)
    x = ml.assemble(vectors.join(parts.select("p_partkey", "p_size", "p_retailprice"), "p_partkey"),
                    ["p_size", "p_retailprice", "features"], "all_features").select("p_partkey", "all_features")
    model = ml.fit_kmeans(x, k=4, seed=SEED, features="all_features", key="p_partkey", rows_per_partition=FIT_ROWS)
    sizes = agg.count_by(ml.assign_clusters(model, x), ["cluster"], "count")
    return sizes.agg(F.sum("count").alias("n_rows"), F.bool_and(F.col("cluster").between(0, 3)).alias("ids_in_range"))
