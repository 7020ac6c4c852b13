"""Retrieval, chunking and evaluation operators on Spark DataFrames."""
