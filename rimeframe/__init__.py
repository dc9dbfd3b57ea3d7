"""Spark-native photogrammetry and motion tracking on DataFrames."""
