"""Operators on ordered sequences: each takes a DataFrame and returns one."""
