"""Structured Streaming form of the row-wise catalog stages."""

from flagloom.streaming.incremental import encode_stream, fixed_vocabularies, read_catalog_stream, run_to_parquet

__all__ = ["encode_stream", "fixed_vocabularies", "read_catalog_stream", "run_to_parquet"]
