"""Structured Streaming forms of the recurring runs."""
