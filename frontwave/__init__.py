"""frontwave: graph analytics on Spark DataFrames."""
