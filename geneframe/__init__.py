"""Sequence and gene-model analytics over Spark DataFrames."""
