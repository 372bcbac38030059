"""Relational operators: filters, similarity joins, clustering, scoring, feeds, audits."""
