"""Readers, writers and schema alignment."""
