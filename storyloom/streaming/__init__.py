"""Structured Streaming forms of the ingest, match and metric operators."""
