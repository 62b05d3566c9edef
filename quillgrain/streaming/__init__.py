"""Structured Streaming forms of the folds."""
