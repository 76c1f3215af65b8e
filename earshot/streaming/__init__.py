"""Streaming ingest and continuously kept results."""
