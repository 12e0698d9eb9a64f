"""Behavioural retention analytics on Spark: DataFrames in, lazy DataFrames out."""
