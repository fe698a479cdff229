"""Profiling, preparation and classification of large tables as Spark jobs."""
