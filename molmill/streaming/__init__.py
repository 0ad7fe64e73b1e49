"""Incremental ingest and running totals."""
