"""Spark-first engine for overlapping structured grids."""
