"""Granary: feed ingest, table archival, file lifecycle and data-quality jobs on Spark."""
