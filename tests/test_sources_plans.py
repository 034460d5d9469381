"""Sources/sinks on hard CSV input, and plan-shape checks (pushdown,
pruning, single scan, no Python in the hot path)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flagloom import session
from flagloom.operators import aggregate as agg
from flagloom.operators import encode
from flagloom.plans import catalog
from flagloom.session import scratch_path
from flagloom.sources import io


def plan(df) -> str:
    """The executed plan; after execution only AQE's final section."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_csv_hard_roundtrip(spark):
    rows = [("line one\nline two", True, "x"), ('say ""hi"", ok', False, ""), ("a,b", None, None), (" pad ", True, "  "),
            ("back\\slash", None, '"'), ("", None, "\t")]
    df = spark.createDataFrame(rows, "t string, f boolean, e string")
    path = io.write_table(df, scratch_path(spark, "csvhard"), fmt="csv", num_files=1)
    back = io.read_table(spark, path, fmt="csv", schema="t string, f boolean, e string", multi_line=True)
    assert sorted(map(str, ((r["t"], r["f"], r["e"]) for r in back.collect()))) == sorted(map(str, rows))


def test_csv_is_split_over_tasks_by_default(spark):
    path = io.write_table(spark.range(200_000), scratch_path(spark, "csvsplit"), fmt="csv", num_files=1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        assert io.read_table(spark, path, fmt="csv", schema="id long").rdd.getNumPartitions() > 1
        assert io.read_table(spark, path, fmt="csv", schema="id long", multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_appended_rows_are_seen(spark, tmp_path):
    path = f"{tmp_path}/part.parquet"
    spark.range(5).write.parquet(path)
    assert catalog.table(spark, str(tmp_path), "part").count() == 5
    spark.range(5).write.mode("append").parquet(path)
    assert catalog.table(spark, str(tmp_path), "part").count() == 10


def test_csv_corrupt_rows_are_kept(spark):
    path = scratch_path(spark, "ragged")
    spark.createDataFrame([("a,1",), ("b,notanint",), ("c,3,extra",)], "v string") \
        .coalesce(1).write.text(path)
    df = io.read_table(spark, path, fmt="csv", schema="k string, n int", header=False, corrupt_column="_bad")
    bad = {r["k"]: r["_bad"] for r in df.collect()}
    assert bad["a"] is None and bad["b"] is not None


def test_sink_manifest_counts_every_row(spark):
    df = spark.range(40).selectExpr("id", "id % 4 k").coalesce(1)
    files = io.sink_manifest(spark, io.write_table(df, scratch_path(spark, "manifest"), partition_by=["k"]))
    got = files.collect()
    assert len(got) == 4 and sum(r["rows"] for r in got) == 40
    assert len({r["file_path"] for r in got}) == 4 and len({r["file_name"] for r in got}) == 1


def test_scratch_uses_checkpoint_dir(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    p = scratch_path(spark, "x")
    address = p.partition(":")[2] if "://" not in root else p  # a folder without a scheme gets one
    assert root and (address.startswith(root.rstrip("/")) or spark.sparkContext.getCheckpointDir() in p)


def test_scratch_paths_name_their_file_system(spark, tmp_path, monkeypatch):
    """A folder without a scheme is one of the default file system, as Spark reads it."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    monkeypatch.setattr(session, "checkpoint_root", lambda _: "/checkpoints")
    assert scratch_path(spark, "x").startswith("file:/checkpoints/flagloom-x-")
    try:
        hadoop.set("fs.viewfs.mounttable.cluster.link./checkpoints", tmp_path.as_uri())
        hadoop.set("fs.defaultFS", "viewfs://cluster/")
        path = scratch_path(spark, "x")
        assert path.startswith("viewfs://cluster/checkpoints/flagloom-x-")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3 and len(list(tmp_path.iterdir())) == 1
    finally:
        hadoop.set("fs.defaultFS", before)
    monkeypatch.setattr(session, "checkpoint_root", lambda _: "hdfs://name:8020/x")
    assert scratch_path(spark, "y").startswith("hdfs://name:8020/x/flagloom-y-")


def test_manifest_lists_files_without_rows(spark):
    path = scratch_path(spark, "listing")
    spark.range(10).selectExpr("id", "id % 2 k").coalesce(1).write.partitionBy("k").parquet(path)
    spark.range(10).where("id < 0").coalesce(1).write.parquet(f"{path}/k=7 %")
    rows = sorted(r["rows"] for r in io.sink_manifest(spark, path).collect())
    assert rows == [0, 5, 5]
    csv = io.write_table(spark.range(0).selectExpr("id"), scratch_path(spark, "none"), fmt="csv")
    got = io.sink_manifest(spark, csv, "csv", "id long").collect()
    assert [r["rows"] for r in got] == [0] and got[0]["file_size"] > 0
    plan_of = plan(io.sink_manifest(spark, path))
    assert "binaryFile" in plan_of and "content" not in plan_of  # listed, not read


def test_files_by_size_with_a_hot_partition(spark):
    df = spark.range(400_000).selectExpr("id", "hash(id) v", "case when id % 100 < 97 then 'hot' else string(id % 100) end k")
    path = io.write_table(df, scratch_path(spark, "sized"), partition_by=["k"], target_bytes=300_000)
    files = io.sink_manifest(spark, path).collect()
    hot = [r["file_size"] for r in files if "/k=hot/" in r["file_path"]]
    assert len(hot) > 4 and max(hot) <= 2 * min(hot)
    assert len(files) == len(hot) + 3 and sum(r["rows"] for r in files) == 400_000
    assert spark.read.parquet(path).select("id", "v", "k").exceptAll(df).isEmpty()
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") != "300000"


def test_rewriting_one_partition_leaves_the_others(spark):
    df = spark.range(30).selectExpr("id", "id % 3 k")
    path = io.write_table(df, scratch_path(spark, "rewrite"), partition_by=["k"])
    before = {r["file_path"] for r in io.sink_manifest(spark, path).collect()}
    io.write_table(df.where("k = 1").withColumn("id", F.col("id") + 100), path, mode="overwrite_partitions", partition_by=["k"])
    after = {r["file_path"] for r in io.sink_manifest(spark, path).collect()}
    assert {f for f in before if "/k=1/" not in f} == {f for f in after if "/k=1/" not in f}
    assert not {f for f in before if "/k=1/" in f} & after
    want = df.selectExpr("case when k = 1 then id + 100 else id end id", "k")
    got = spark.read.schema("id long, k long").parquet(path)
    assert got.exceptAll(want).isEmpty() and got.count() == 30
    with pytest.raises(ValueError):
        io.write_table(df, path, mode="overwrite_partitions")


def scanned(df) -> int:
    """Rows that the executed plan's scan gave out."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_clustered_layout_is_pruned(spark):
    df = spark.range(300_000).selectExpr("id", "pmod(hash(id), 100000) c", "case when id % 50 = 0 then 'P' else 'F' end s")
    path = io.write_clustered(df, scratch_path(spark, "clustered"), ["c"], ["s"], bloom={"id": 50_000}, num_files=6)
    read = spark.read.parquet(path)
    ranged = read.where("s = 'F' AND c BETWEEN 500 AND 900")
    assert "PartitionFilters: [isnotnull(s#" in plan(ranged) and "PushedFilters: [IsNotNull(c)" in plan(ranged)
    assert ranged.count() == df.where("s = 'F' AND c BETWEEN 500 AND 900").count()
    assert scanned(ranged) < 300_000 / 4 and scanned(read.where("s = 'P'")) == 6000
    point = read.where("id = 123457")  # ids are everywhere in every file: only the bloom filter can tell
    assert point.count() == 1 and scanned(point) < 300_000 / 3
    bare = io.write_clustered(df, scratch_path(spark, "clustered"), ["c"], ["s"], num_files=6)
    assert scanned(spark.read.parquet(bare).where("id = 123457")) > scanned(point)


def test_footer_facts_are_pushed_into_the_scan(spark):
    df = spark.range(1000).selectExpr("id", "id / 7 v", "id % 3 k")
    path = io.write_table(df, scratch_path(spark, "footers"), partition_by=["k"])
    whole = io.footer_facts(spark, path, ["id"], ["id", "v"])
    assert "PushedAggregation: [COUNT" in plan(whole).replace("COUNT(*)", "COUNT")
    assert whole.columns == ["rows", "min_id", "max_id", "max_v"] and tuple(whole.first()) == (1000, 0, 999, 999 / 7)
    each = io.footer_facts(spark, path, ["id"], by=["k"])
    assert "PushedAggregation" in plan(each) and sorted(map(tuple, each.collect())) == [(0, 334, 0), (1, 333, 1), (2, 333, 2)]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_bad_rows_are_set_apart(spark):
    path = scratch_path(spark, "ragged")
    lines = ["1,a,2.5", "2,b", "3,c,4.5,x", "four,d,5.5", "5,e,n/a", "", '6,"f,g",7.5', "7,,"]
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(path)
    raw = io.read_table(spark, path, fmt="csv", schema="k int, n string, x double", header=False, corrupt_column="_line")
    good, bad = io.split_bad_rows(raw, "_line", scratch_path(spark, "split"))
    assert good.columns == ["k", "n", "x"] and bad.columns == ["line"]
    assert sorted((r["k"], r["n"], r["x"]) for r in good.select("k", "n", "x").collect() if r["k"] != 7) == [(1, "a", 2.5), (6, "f,g", 7.5)]
    assert good.where("k = 7").count() == 1
    assert sorted(r["line"] for r in bad.collect()) == ["2,b", "3,c,4.5,x", "5,e,n/a", "four,d,5.5"]


def test_filter_pushdown_and_pruning(spark):
    df = catalog.QUERIES["filter_equality_range"](spark, SF_SMALL)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_orderdate), EqualTo(o_orderstatus,F)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double" in p
    assert "o_orderpriority" not in p


def test_two_way_pct_single_scan(spark):
    df = catalog.QUERIES["two_way_pct_by_flag"](spark, SF_SMALL)
    df.collect()
    p = plan(df)
    assert p.count("FileScan parquet") == 1
    assert "ReadSchema: struct<p_name:string,p_type:string>" in p


def test_flag_totals_single_scan_no_python(spark):
    df = catalog.QUERIES["flag_totals"](spark, SF_SMALL)
    p = plan(df)
    assert p.count("FileScan parquet") == 1
    assert "Python" not in p and "ArrowEval" not in p


def test_flagship_partial_aggregation_and_group_limit(spark):
    df = catalog.QUERIES["top_tag_per_brand"](spark, SF_SMALL)
    df.collect()
    p = plan(df)
    assert "partial_count" in p and "WindowGroupLimit" in p
    assert "ReadSchema: struct<p_name:string,p_brand:string>" in p


def test_boolean_like_one_job_for_all_columns(spark):
    part = catalog.table(spark, SF_SMALL, "part")
    from flagloom.operators import clean
    df = clean.boolean_like_columns(part)
    p = plan(df)
    assert p.count("FileScan parquet") == 1


def test_no_python_udfs_anywhere(spark):
    for name, fn in catalog.QUERIES.items():
        p = plan(fn(spark, SF_SMALL))
        assert not any(x in p for x in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct")), name


def test_share_of_total_reuses_the_grouped_exchange(spark):
    df = agg.share_of_total(catalog.table(spark, SF_SMALL, "orders"), ["o_orderpriority"])
    df.collect()
    assert "Subquery" in plan(df) and "ReusedExchange" in plan(df)


def test_vocabulary_one_hot_single_projection(spark):
    o = catalog.table(spark, SF_SMALL, "orders").select("o_orderkey", "o_orderpriority")
    out = encode.one_hot(o, "o_orderpriority", as_type="int")
    assert len(out.columns) == 2 + 5
    assert plan(out).count("Project") == 1
