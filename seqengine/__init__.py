"""Spark operators for ordered streams: many independent sequences whose rows have meaning in order."""
