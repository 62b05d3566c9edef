"""Adapters of the given tables."""
