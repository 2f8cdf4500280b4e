"""Operators of a training-data pipeline: encoding, filtering, deduplication, scoring and output."""
