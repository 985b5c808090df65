"""Access-log threat analytics on Spark DataFrames."""
