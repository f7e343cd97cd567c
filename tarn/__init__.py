"""Reproducible analytics over Spark DataFrames."""
