"""Entity-graph risk analytics on Spark DataFrames."""
