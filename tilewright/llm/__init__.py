"""Operators of a training-data pipeline: language, duplicates, contamination, search, packing."""
