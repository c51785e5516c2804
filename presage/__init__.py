"""Forecast scoring and evidence pooling on Spark DataFrames."""
