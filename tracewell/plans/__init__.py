"""Registered queries: plain callables over a data directory, and their SQL twins."""
