"""Spark-native analytics over raster, vector and evaluation tables."""
