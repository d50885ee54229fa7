"""Streaming forms of the queries."""
