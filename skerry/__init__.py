"""A full-text search and ranking engine on Spark DataFrames."""
