"""Query catalogue on the driver tables and composed catalog paths."""
