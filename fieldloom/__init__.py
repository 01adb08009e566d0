"""Spark jobs for gridded monthly series, dated points and per-cell features."""
