"""Patterns, prefixes, word lists and legal references. Larger tables are parameters."""
