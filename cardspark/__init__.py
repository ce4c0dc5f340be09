"""Learned cardinality estimation and approximate query processing on Spark DataFrames."""
