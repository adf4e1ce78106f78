"""Ingestion with Structured Streaming: a stream of changes applied to a table in micro-batches."""
