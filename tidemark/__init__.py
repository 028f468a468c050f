"""Tidemark: point-in-time market-state analytics on Spark DataFrames."""
