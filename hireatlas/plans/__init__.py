"""Composite jobs and the test-data queries."""
