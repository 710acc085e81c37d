"""Chunked, streaming-style classification analytics on Spark DataFrames."""
