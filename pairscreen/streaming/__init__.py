"""Structured Streaming: ingest, deduplicate, count and encode what arrives."""
