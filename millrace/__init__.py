"""Data-preparation operators for Spark: typed options in, DataFrames out."""
