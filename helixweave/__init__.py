"""Exact pairwise sequence comparison on Spark DataFrames."""
