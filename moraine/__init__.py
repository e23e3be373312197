"""Density-hierarchy analytics on Spark DataFrames."""
