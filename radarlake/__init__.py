"""Spark-native analytics for chunked two-dimensional radar rasters."""
