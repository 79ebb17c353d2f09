"""Graph-centrality analytics on Spark DataFrames."""
