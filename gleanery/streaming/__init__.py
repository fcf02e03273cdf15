"""Structured Streaming versions of the ingest plans."""
