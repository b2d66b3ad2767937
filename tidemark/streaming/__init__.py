"""Structured Streaming jobs for incremental ingest and current-revision views."""
