"""Incremental ingest and aggregates."""
