"""Tidemark: time-series, timed-text and interval analytics on Spark DataFrames."""
