"""Freight-rate analytics as Spark jobs."""
