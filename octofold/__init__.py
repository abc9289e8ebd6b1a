"""Sparse-volume and trajectory analytics as Spark jobs."""
