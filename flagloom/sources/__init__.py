"""Sources and sinks."""

from flagloom.sources.io import preview, read_table, sink_manifest, small_table, write_table

__all__ = ["preview", "read_table", "sink_manifest", "small_table", "write_table"]
