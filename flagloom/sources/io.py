"""Readers, writers and output manifests.

CSV is kept as an import/export format; Parquet is the default between
stages because it keeps types and lets Catalyst prune columns and push
filters into the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: How a null is written in CSV, apart from an empty text.
NULL_TEXT = "\\N"


def csv_options(null_text: str = NULL_TEXT) -> dict[str, str]:
    """The options under which CSV text survives a round trip; the same on both sides."""
    return {"quote": '"', "escape": '"', "nullValue": null_text,
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | str | None = None, infer: bool = False,
               header: bool = True, corrupt_column: str | None = None,
               multi_line: bool = False, null_text: str = NULL_TEXT) -> DataFrame:
    """Read a table directory or file.

    CSV is read as :func:`write_table` writes it: quoted commas, doubled
    quotes, padded and empty texts come back as they were, ``null_text`` is
    null. By default a file is split over tasks, and a quoted newline would end
    its row; ``multi_line=True`` keeps newlines inside quotes, but then a file is
    one task, so write many files. Give ``schema`` in
    production; ``infer=True`` costs an extra pass over the files. With
    ``corrupt_column`` malformed CSV rows are kept in that column instead of
    shifting values into the wrong fields; :func:`split_bad_rows` sets them apart.
    """
    if fmt == "parquet":
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        return r.parquet(path)
    if fmt != "csv":
        r = spark.read.format(fmt)
        if schema is not None:
            r = r.schema(schema)
        return r.load(path)
    r = spark.read.option("header", header).option("mode", "PERMISSIVE").option("multiLine", multi_line)
    r = r.options(**csv_options(null_text))
    if schema is not None:
        if corrupt_column:
            if isinstance(schema, str):
                schema = f"{schema}, {corrupt_column} string"
            else:
                schema = StructType(list(schema.fields)).add(corrupt_column, "string")
            r = r.option("columnNameOfCorruptRecord", corrupt_column)
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None, num_files: int | None = None,
                max_records_per_file: int | None = None, target_bytes: int | None = None,
                null_text: str = NULL_TEXT) -> str:
    """Write ``df`` and return ``path``.

    ``num_files`` repartitions (a shuffle that keeps upstream parallelism)
    rather than ``coalesce`` (which would drag the whole upstream plan into
    that many tasks). ``max_records_per_file`` bounds file size without a
    shuffle and is the better knob at scale. ``target_bytes`` deals the rows by
    size instead (of the shuffled form; the files' own is about proportional): the
    ``REBALANCE`` hint with adaptive execution splits what is larger, by
    ``partition_by`` values where given, and joins what is smaller, so a hot value
    becomes many files of one size and a rare one a single file.

    ``mode="overwrite_partitions"`` replaces only the ``partition_by`` values that
    ``df`` has rows of; a rerun of one partition leaves the others. In CSV a null is
    written as ``null_text``; a text equal to it could not be told apart.
    """
    spark = df.sparkSession
    if num_files and target_bytes:
        raise ValueError("num_files or target_bytes, not both")
    if num_files:
        df = df.repartition(num_files)
    if target_bytes:
        df = df.hint("rebalance", *(partition_by or []))
    if mode == "overwrite_partitions" and not partition_by:
        raise ValueError("overwrite_partitions needs partition_by")
    w = df.write.mode("overwrite" if mode == "overwrite_partitions" else mode)
    if mode == "overwrite_partitions":
        w = w.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if fmt == "csv":
        w = w.option("header", True).options(**csv_options(null_text))
    sizes = {"spark.sql.adaptive.enabled": "true",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes)} if target_bytes else {}
    with session_conf(spark, sizes):
        w.format(fmt).save(path)
    return path


@contextmanager
def session_conf(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """``values`` hold inside the block; afterwards the session has its own again."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_clustered(df: DataFrame, path: str, cluster_by: Sequence[str], partition_by: Sequence[str] | None = None,
                    bloom: Mapping[str, int] | None = None, num_files: int | None = None,
                    row_group_bytes: int | None = None) -> str:
    """Write Parquet laid out for pruning and return ``path``.

    Rows are dealt by ranges of (``partition_by``, ``cluster_by``) and sorted, so each
    file and row group holds a narrow range and a filter on ``cluster_by`` skips the
    others by their statistics; a hot partition value is many ranges. ``partition_by``
    values become folders that a filter never lists. ``bloom`` gives columns for
    point lookups a bloom filter for about so many distinct values a file.
    """
    keys = [*(partition_by or []), *cluster_by]
    dealt = df.repartitionByRange(num_files, *keys) if num_files else df.repartitionByRange(*keys)
    w = dealt.sortWithinPartitions(*keys).write
    if partition_by:
        w = w.partitionBy(*partition_by)
    for c, distinct in (bloom or {}).items():
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(
            f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes))
    w.parquet(path)
    return path


def footer_facts(spark: SparkSession, path: str, least: Sequence[str] = (), greatest: Sequence[str] = (),
                 by: Sequence[str] = ()) -> DataFrame:
    """``rows``, ``min_<column>`` and ``max_<column>`` of a Parquet table from its
    files' footers alone, for each value of the partition columns ``by``.

    Reads no column: the aggregates are pushed into the scan. Columns are whole or
    floating numbers, dates or booleans (texts and timestamps have no exact footer
    bounds: aggregate those over the rows); a file written without statistics is an
    error. The frame belongs to a session of its own, in which Parquet goes through
    the reader that takes aggregates.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(
        s for s in own.conf.get("spark.sql.sources.useV1SourceList").split(",") if s != "parquet"))
    return own.read.parquet(path).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.min(c).alias(f"min_{c}") for c in least],
        *[F.max(c).alias(f"max_{c}") for c in greatest])


def split_bad_rows(df: DataFrame, corrupt_column: str, path: str) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` of a CSV read with ``corrupt_column``: the rows that fit the
    schema, without that column, and the raw lines (``line``) of those that do not.

    A row with too few or too many fields, or with a field that its type cannot
    read, is bad as a whole; an empty line is no row. The files are read once: both
    sides are written to folders of ``path`` and read from there."""
    marked = df.withColumn("_is_bad", F.col(corrupt_column).isNotNull())
    marked.write.partitionBy("_is_bad").parquet(path)
    kept = df.sparkSession.read.schema(marked.schema).parquet(path)
    return (kept.where("NOT _is_bad").drop(corrupt_column, "_is_bad"),
            kept.where("_is_bad").select(F.col(corrupt_column).alias("line")))


def sink_manifest(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: StructType | str | None = None) -> DataFrame:
    """One row per data file of a written set: path, name, size in bytes, rows.

    Files are told apart by path: the same name may be in several partition
    folders. The files are listed by Spark's own file source, without reading them,
    so a file without rows is there too (0); their rows are counted through the
    reader's hidden ``_metadata`` column, a distributed scan.
    """
    meta = lambda c: F.col(f"_metadata.{c}").alias(c)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select(meta("file_path"), meta("file_name"), meta("file_size")))
    rows = (read_table(spark, path, fmt, schema=schema).select(meta("file_path"))
            .groupBy("file_path").agg(F.count(F.lit(1)).alias("rows")))
    return (files.join(rows, "file_path", "left")
            .select("file_path", "file_name", "file_size", F.coalesce("rows", F.lit(0)).alias("rows")))


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    """A small frame from driver-side rows with an explicit schema.

    Only for bounded inputs (a parameter list, a model's per-feature
    output); anything that grows with the data stays distributed.
    """
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order_by`` the rows are defined (a top-k)."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)
