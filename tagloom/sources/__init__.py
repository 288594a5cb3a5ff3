"""Readers and writers on Spark's own file sources, with explicit schemas."""
