"""Readers for landed payloads and writers for result tables."""
