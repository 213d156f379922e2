"""Structured Streaming forms of the folds: state for each clip, one row after another."""
