"""Structured Streaming: ingest, rolling aggregates, change feed and views."""
