"""Incremental catalog encoding with Structured Streaming.

Stage 1 (encode) and the row-wise part of stage 2 (features) are pure
projections, so the same operators run unchanged on a streaming frame: new
raw-catalog files are picked up, encoded and appended to a Parquet table.
Vocabularies must be given up front (a stream's schema cannot change
between micro-batches). The checkpoint lives under the cluster's shared
``spark.checkpoint.dir``, so a restarted query resumes where it stopped and
a lost executor only re-runs its tasks of the current micro-batch.
De-duplication across all titles is a batch step on the written table
(``dedupe.dedupe``), not unbounded stream state.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from flagloom.plans import pipeline
from flagloom.session import scratch_path
from flagloom.sources.io import csv_options


def read_catalog_stream(spark: SparkSession, source_dir: str, schema: StructType | str, fmt: str = "csv",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).options(**csv_options())
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.format(fmt).load(source_dir)


def encode_stream(stream: DataFrame, spec: pipeline.CatalogSpec) -> tuple[pipeline.Encoded, DataFrame]:
    """Stage 1 + row-wise stage 2 on a streaming frame (vocabularies required)."""
    if spec.genre_vocab is None or spec.rating_vocab is None or spec.country_vocab is None:
        raise ValueError("a streaming encode needs genre_vocab, rating_vocab and country_vocab")
    enc = pipeline.encode_catalog(stream, spec)
    return enc, pipeline.feature_catalog(enc, spec)


def run_to_parquet(features: DataFrame, sink_dir: str, checkpoint: str | None = None,
                   available_now: bool = True, query_name: str | None = None):
    """Append the stream to Parquet; ``available_now`` processes what is there
    and stops (a scheduled incremental job), otherwise it keeps running."""
    spark = features.sparkSession
    w = (features.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(sink_dir)


def fixed_vocabularies(spec: pipeline.CatalogSpec, batch: DataFrame) -> pipeline.CatalogSpec:
    """Fill missing vocabularies of ``spec`` from a batch of the catalog (one
    scan of all of it), so the stream's schema is fixed before it starts."""
    enc = pipeline.encode_catalog(batch, spec)
    return replace(spec, genre_vocab=list(enc.genre_flags.values()),
                   rating_vocab=list(enc.rating_flags.values()),
                   country_vocab=list(enc.country_flags.values()))
