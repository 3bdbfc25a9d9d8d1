"""Incremental ingest of landed feed files with Structured Streaming."""
