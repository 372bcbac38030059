"""Queries composed from the operators, with their SQL equivalents."""
