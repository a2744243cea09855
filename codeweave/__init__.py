"""Code-graph analytics as Spark DataFrames."""
